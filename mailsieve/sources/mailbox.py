"""A data source for mail as it lies on disk: mailboxes, mail folders with one file a message, single files.

``spark.read.format("mailbox").load(path)`` gives one row for each message under ``path`` (any file system that Arrow
opens, by address). A partition is a list of byte ranges of about ``partition_bytes``: a large mailbox is cut into many,
small files share one. A message belongs to the range in which its separator line starts, so every message is read once
whatever the cuts. A task holds one message and one batch of about ``batch_bytes``.

A file whose first bytes are ``From `` is a mailbox; each line that starts so after a line end begins a message; the
blank line before it goes, and one ``>`` is taken off lines of ``>``s and ``From ``. Every other file is one message. Columns: ``id`` (path and byte
position), ``delivered_at`` (the separator line's time; the leading seconds of a mail folder's file name, as UTC; else
null), ``was_unread`` (no ``R`` in the Status header; no ``S`` among the flags of the file name; files of neither kind
are unread) and ``content``. Empty files hold no message.

Comparisons of ``delivered_at`` with a value and conditions on ``was_unread`` are used while reading: files of a mail
folder are left out by name, unopened; messages of mailboxes are passed over before they reach Spark. Spark applies all
filters again, so results never depend on it.

The stream reads mailboxes that grow. Its offset is the size of each file, so it is meant for mailboxes; folders with
one file a message are better read with Spark's own file stream. Writers must append whole messages.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from mailsieve.sources import mail

SCHEMA = "id string, delivered_at timestamp_ntz, was_unread boolean, content binary"
_ARROW = pa.schema([("id", pa.string()), ("delivered_at", pa.timestamp("us")), ("was_unread", pa.bool_()), ("content", pa.binary())])
_SEPARATOR = b"\nFrom "
_CHUNK = 1 << 20
_QUOTED = re.compile(rb"^>(>*From )", re.MULTILINE)
_BLANK_END = re.compile(rb"(\r?\n)\r?\n\Z")
_STATUS = re.compile(rb"^status:[ \t]*(\S*)", re.MULTILINE | re.IGNORECASE)
_FOLDER_FILE = re.compile(r"(\d{9,11})\.[^/]*$")
_FLAGS = re.compile(r":2,([A-Za-z]*)$")


@dataclass(frozen=True)
class Span:
    """Messages of one file whose separator starts at ``start`` or later and before ``end``; bytes from ``size`` on are
    not looked at."""
    path: str
    start: int
    end: int
    size: int


@dataclass
class Spans(ds.InputPartition):
    parts: list[Span]


def open_path(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if re.match(r"[a-z][a-z0-9+.-]*:", address) else (fs.LocalFileSystem(), posixpath.abspath(address))


def _files(address: str) -> list[tuple[str, int]]:
    system, path = open_path(address)
    found = system.get_file_info([path])[0]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(address)
    if found.type == fs.FileType.File:
        return [(found.path, found.size)]
    listed = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = re.compile(r"(^|/)[._]")
    return sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and not hidden.search(f.path[len(path):]))


def cut(files: list[tuple[str, int, int]], partition_bytes: int) -> list[Spans]:
    """(path, from, size) -> partitions of about ``partition_bytes``, an opened file counting 4 KB."""
    out: list[Spans] = []
    open_parts: list[Span] = []
    held = 0
    for path, first, size in files:
        at = first
        while at < size:
            end = min(size, at + partition_bytes - held)
            open_parts.append(Span(path, at, end, size))
            held += end - at + 4096
            at = end
            if held >= partition_bytes:
                out.append(Spans(open_parts))
                open_parts, held = [], 0
    return out + ([Spans(open_parts)] if open_parts else [])


def _named(path: str) -> tuple[dt.datetime | None, bool]:
    """Time of delivery and unread state that the name of a mail folder's file tells."""
    seconds, flags = _FOLDER_FILE.search(path), _FLAGS.search(path)
    at = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(seconds[1])) if seconds else None
    return at, flags is None or "S" not in flags[1]


def _separator_time(line: bytes) -> dt.datetime | None:
    words = line.decode("ascii", "replace").split()
    try:
        return dt.datetime.strptime(" ".join(words[-4:]), "%b %d %H:%M:%S %Y")
    except ValueError:
        return None


def _mailbox_messages(source, span: Span) -> Iterator[tuple[int, bytes]]:
    """(position, bytes with the separator line) of the messages that begin in the span."""
    at = max(span.start - 1, 0)  # the line end before a separator may be the byte before the span
    source.seek(at)
    # a separator at the very beginning has no line end before it
    held, base = (b"\n", -1) if at == 0 else (b"", at)
    begun, searched, done = None, 0, False
    while True:
        found = held.find(_SEPARATOR, searched)
        if found >= 0:
            position = base + found + 1
            if begun is not None:
                yield begun, held[begun - base:found + 1]
            if position >= span.end:
                return
            begun = position if position >= span.start else None
            searched = found + 1
            if begun is not None and begun > base:
                held, base, searched = held[begun - base:], begun, 0
            continue
        if done:
            break
        if begun is None and base + len(held) > span.end:
            return
        searched = max(len(held) - len(_SEPARATOR) + 1, 0)
        if begun is None:
            held, base, searched = held[searched:], base + searched, 0
        parts, room = [held], max(_CHUNK, len(held))  # doubling: a long message is copied a few times, not once a chunk
        while room > 0 and (more := source.read(min(room, _CHUNK, span.size - source.tell()))):
            parts.append(more)
            room -= len(more)
        done = room > 0
        held = b"".join(parts)
    if begun is not None:
        yield begun, held[begun - base:]


def _messages(span: Span, system: fs.FileSystem, wanted) -> Iterator[tuple]:
    named_at, named_unread = _named(span.path)
    with system.open_input_file(span.path) as source:
        if source.read(min(5, span.size)) != b"From ":
            if span.start == 0 and wanted(named_at, named_unread):
                source.seek(0)
                yield span.path, named_at, named_unread, source.read(span.size)
            return
        for position, raw in _mailbox_messages(source, span):
            line, _, content = raw.partition(b"\n")
            head = re.split(rb"\r?\n\r?\n", content, maxsplit=1)[0]
            status, at = _STATUS.search(head), _separator_time(line)
            unread = status is None or b"R" not in status[1].upper()
            if wanted(at, unread):
                yield f"{span.path}#{position}", at, unread, _QUOTED.sub(rb"\1", _BLANK_END.sub(rb"\1", content))


_COMPARE = {
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.EqualTo: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b}


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tests: list[tuple[str, type, object]] = []

    def wanted(self, at: dt.datetime | None, unread: bool) -> bool:
        values = {"delivered_at": at, "was_unread": unread}
        return all(values[name] is not None and _COMPARE[kind](values[name], value) for name, kind, value in self.tests)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        rows, held = [], 0
        for span in partition.parts:
            for row in _messages(span, system, self.wanted):
                rows.append(row)
                held += len(row[3]) + 200
                if held >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class MailboxReader(_Reading, ds.DataSourceReader):
    def pushFilters(self, filters):
        for test in filters:
            value = getattr(test, "value", None)
            usable = type(test) in _COMPARE and test.attribute in (("delivered_at",), ("was_unread",))
            if usable and isinstance(value, bool if test.attribute == ("was_unread",) else dt.datetime):
                self.tests.append((test.attribute[0], type(test), value))
            elif isinstance(test, ds.Not) and getattr(test.child, "attribute", None) == ("was_unread",) and isinstance(test.child, ds.EqualTo):
                self.tests.append(("was_unread", ds.EqualTo, not test.child.value))
            yield test

    def partitions(self):
        """Files of mail folders that no wanted message can be in are not opened. A file may still be a mailbox when
        its name says nothing."""
        files = [(p, 0, n) for p, n in _files(self.path) if not self.tests or _FOLDER_FILE.search(p) is None or self.wanted(*_named(p))]
        return cut(files, self.partition_bytes) or [Spans([])]


class MailboxStream(_Reading, ds.DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        return dict(_files(self.path))

    def partitions(self, start, end):
        return cut([(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)], self.partition_bytes)


class MailboxSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MailboxReader(self.options)

    def streamReader(self, schema):
        return MailboxStream(self.options)


def _prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailboxSource)


def read_mailboxes(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """One row of ``SCHEMA`` for each message under ``path``."""
    _prepared(spark)
    return spark.read.format("mailbox").option("partition_bytes", partition_bytes).load(path)


def stream_mailboxes(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """The messages of mailboxes as they are appended."""
    _prepared(spark)
    return spark.readStream.format("mailbox").option("partition_bytes", partition_bytes).load(path)


def ingest_mailboxes(raw: DataFrame) -> DataFrame:
    """Rows of ``read_mailboxes`` or ``stream_mailboxes``, filtered or not, as parsed messages with ``delivered_at`` and
    ``was_unread``."""
    return mail.parse_mail(raw, ("delivered_at", "was_unread")).withColumn("was_unread", F.coalesce("was_unread", F.lit(True)))
