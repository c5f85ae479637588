"""The mailbox source: cuts, folders, pushed filters, streams."""

import datetime as dt
import mailbox as std
import os
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.sources import mail, mailbox


def separator(i, day=None):
    return b"From s%d@x.org %s\n" % (i, (day or dt.datetime(2024, 1, 1) + dt.timedelta(days=i)).strftime("%a %b %e %H:%M:%S %Y").encode())


def message(i, body=b"", status=b""):
    head = b"From: Ann <s%d@x.org>\nSubject: m%d\nDate: 5 Mar 2024 09:08:07 +0000\n" % (i, i)
    return head + (b"Status: %s\n" % status if status else b"") + b"\n" + body


def write(path, messages):
    with open(path, "ab") as out:
        for i, body, status in messages:
            out.write(separator(i) + message(i, body, status) + b"\n\n")


def hostile(n, seed=0):
    rng = random.Random(seed)
    bodies = [b"", b"From:", b">From the start\n>>From two", b"x" * 5000, b"\n\nFro\nm From inside\n", b"a\r\nb", b"\xff\xfe bytes", b"\n" * 20]
    return [(i, rng.choice(bodies) + b" %d" % rng.randrange(10 ** 9), rng.choice([b"", b"RO", b"O"])) for i in range(n)]


def spans(path, size, partition_bytes):
    system, local = mailbox.open_path(str(path))
    for part in mailbox.cut([(local, 0, size)], partition_bytes):
        for span in part.parts:
            yield from mailbox._messages(span, system, lambda at, unread: True)


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
def test_every_cut_gives_every_message_once(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(mailbox, "_CHUNK", chunk)
    rows = hostile(40)
    write(tmp_path / "box", rows)
    size = os.path.getsize(tmp_path / "box")
    whole = list(spans(tmp_path / "box", size, size + 1))
    plain = [m.as_bytes() for m in std.mbox(tmp_path / "box", create=False)]
    assert [w[3].split(b"\n")[1] for w in whole] == [b"Subject: m%d" % i for i, *_ in rows] and len(plain) == len(whole)
    for i, body, status in rows:
        read = body.replace(b">From the start\n>>From two", b"From the start\n>From two")
        assert whole[i][3] == message(i, read, status) + b"\n"
        assert whole[i][1] == dt.datetime(2024, 1, 1) + dt.timedelta(days=i) and whole[i][2] == (b"R" not in status)
    for partition_bytes in (4097, 4100, 4200, 5003, 9000, 20000):
        assert list(spans(tmp_path / "box", size, partition_bytes)) == whole


def test_a_large_mailbox_is_read_by_many_tasks(spark, tmp_path):
    write(tmp_path / "box", [(i, b"y" * 2000, b"") for i in range(2000)])
    for i in range(200):
        (tmp_path / f"m{i}.eml").write_bytes(message(5000 + i))
    (tmp_path / "empty").write_bytes(b"")
    frame = mailbox.read_mailboxes(spark, str(tmp_path), partition_bytes=1 << 18)
    sizes = frame.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).collect()
    assert len(sizes) > 15 and max(r.n for r in sizes) < 1 << 19
    got = mail.good_mail(mailbox.ingest_mailboxes(frame))
    assert got.count() == got.select("id").distinct().count() == 2200
    assert got.where("sender_email IS NOT NULL AND sender_email != ''").agg(F.sum(F.substring("subject", 2, 9).cast("int"))).first()[0] == sum(range(2000)) + sum(range(5000, 5200))


def test_filters_are_used_while_reading_and_change_nothing(spark, tmp_path):
    write(tmp_path / "box", hostile(60, 1))
    (tmp_path / "cur").mkdir()
    for i in range(20):
        at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=i)
        (tmp_path / "cur" / f"{int(at.timestamp())}.M{i}.host:2,{'S' if i % 2 else ''}").write_bytes(message(100 + i))
    (tmp_path / "lone.eml").write_bytes(message(900))
    frame = mailbox.read_mailboxes(spark, str(tmp_path))
    rows = frame.collect()
    assert len(rows) == 81
    bound = dt.datetime(2024, 1, 10)
    late = frame.where((F.col("delivered_at") >= F.lit(bound).cast("timestamp_ntz")) & F.col("was_unread"))
    assert sorted(r.id for r in late.collect()) == sorted(r.id for r in rows if r.delivered_at and r.delivered_at >= bound and r.was_unread)
    assert frame.where(~F.col("was_unread")).count() == sum(not r.was_unread for r in rows)
    reader = mailbox.MailboxReader({"path": str(tmp_path)})
    filters = [mailbox.ds.GreaterThanOrEqual(("delivered_at",), bound), mailbox.ds.EqualTo(("was_unread",), True)]
    assert list(reader.pushFilters(filters)) == filters
    opened = [s.path for p in reader.partitions() for s in p.parts]
    assert len(opened) == 2 + sum(1 for i in range(20) if i >= 9 and not i % 2)
    read = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["id"] for r in read) == sorted(r.id for r in late.collect())


def test_growing_mailboxes_as_a_stream(spark, tmp_path):
    box, out = tmp_path / "in", tmp_path / "out"
    box.mkdir()
    rows = hostile(50, 2)
    for first in (0, 20, 35):
        write(box / "a", rows[first:first + 15])
        write(box / f"b{first}", rows[first + 15:first + 20] if first != 20 else [])
        stream = mailbox.ingest_mailboxes(mailbox.stream_mailboxes(spark, str(box), partition_bytes=4500))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
    got = spark.read.parquet(str(out))
    whole = mailbox.ingest_mailboxes(mailbox.read_mailboxes(spark, str(box)))
    columns = ["id", "subject", "body", "delivered_at", "was_unread"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, whole.select(columns).collect())) and got.count() > 40


def test_no_files_and_no_path(spark, tmp_path):
    assert mailbox.read_mailboxes(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception):
        mailbox.read_mailboxes(spark, str(tmp_path / "none")).collect()
