import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailsieve.plans.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


MESSAGE = (
    "msg_id bigint, sender_email string, sender_domain string, subject string, body string, "
    "received_at timestamp_ntz, raw_headers map<string,array<string>>")


@pytest.fixture
def messages(spark):
    """Build message rows from dicts; what is left out is NULL."""
    def build(*rows, schema=MESSAGE):
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n, i if n == "msg_id" else None) for n in names) for i, r in enumerate(rows)], schema)
    return build
