r"""WARC archives, written and read back by Spark; the reader salvages what damaged files still hold.

Archives are plain, or compressed with one gzip member per record. Spark's text writer stores the records as
they are: its separator is the end of a plain record, or an empty gzip member, so the files are ordinary
archives, written and retried like any table in any store Spark can write to. Its text reader cuts files at
the start of a member (``1f 8b 08``) or of a version line (``WARC/1.``), and so reads parts of one archive in
many tasks.

Every cut is a place where a record may start. A record counts once all checks hold: the gzip checksum, the
version line, the lengths, the blank lines at its end, the digests of block and payload. After a failed check
the reader goes on at the next cut, so one damaged record costs that record only; bytes between records that
count are quarantined and logged. A cut inside a record (a payload may hold the marks too) is passed over with
the record it is in. Where a record is still open at the end of a task's part, its file is read again as one
stream, in order: this gives every file the result of a reader that starts at its first byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, prepare

MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
END = b"\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
PAGE = "urn:page:"
LIMIT = 256 << 20
MAX_HEADER = 1 << 16
FLUSH = 8 << 20
VISIBLE = "".join(map(chr, range(33, 127)))


def digest(data: bytes, algorithm: str = "sha1") -> str:
    return base64.b32encode(hashlib.new(algorithm, data, usedforsecurity=False).digest()).decode()


# --- writing ---


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    lines += [f"{name}: {value}" for name, value in fields if value is not None]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _response(page_id: int | None, uri: str | None, payload: bytes, revisit: bool, refers: int | None,
              refers_uri: str | None, date: str) -> bytes:
    """The response with its payload; a revisit has the HTTP header alone, and the digest of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()

    def named(number: int | None) -> str:
        return f"{PAGE}{'none' if number is None else number}"

    def plain(address: str | None) -> str | None:
        return None if address is None else quote(address, safe=VISIBLE)

    fields = [
        ("WARC-Date", date), ("WARC-Target-URI", plain(uri)), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if not revisit:
        return _record("response", named(page_id), fields, head + payload)
    fields += [
        ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{named(refers)}>"),
        ("WARC-Refers-To-Target-URI", plain(refers_uri)), ("WARC-Refers-To-Date", date),
    ]
    return _record("revisit", named(page_id), fields, head)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to, refers_to_uri) of every row of ``pages`` (page_id, url, html).

    A null html is the empty payload. Of equal payloads of at least ``least_bytes`` bytes the rows with the
    largest page_id keep theirs, the others refer to it; a row without an id does so unless none has one.
    Digests alone are grouped; payloads travel only where the table of repeated digests is too large for
    Spark to broadcast, and then a hot digest is one that Spark's skew handling splits.
    """
    scratch = Scratch(prepare(pages.sparkSession), "revisits")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("same", F.unhex(F.sha2("payload", 256)))
    repeated = scratch.store(
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("same")
        .agg(
            F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_to_uri"),
            F.count(F.lit(1)).alias("copies"),
        )
        .filter("copies > 1"),
        "repeated",
    )
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.join(repeated, "same", "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"),
        F.when(revisit, F.col("refers_to")).alias("refers_to"), F.when(revisit, F.col("refers_to_uri")).alias("refers_to_uri"),
    )


def write_archives(records: DataFrame, folder: str, compressed: bool = True, level: int = 6, date: str = DATE) -> None:
    """One archive per task, of the rows ``revisits`` gives. It starts with a warcinfo record."""

    def stored(record: bytes) -> bytes:
        if not compressed:
            return record
        packer = zlib.compressobj(level, wbits=31)
        return packer.compress(record + END) + packer.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, begun = [], 0, False
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if not begun:
                    info = b"software: tallyhouse\r\nformat: WARC file version 1.1\r\n"
                    out.append(stored(_record("warcinfo", "urn:info", [("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)))
                    begun = True
                out.append(stored(_response(*row, date)))
                held += len(out[-1])
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    columns = ["page_id", "url", "payload", "revisit", "refers_to", "refers_to_uri"]
    values = records.select(columns).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    separator = (EMPTY_MEMBER if compressed else END).decode("latin-1")
    values.write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(folder)


# --- reading ---


class Found(NamedTuple):
    """A record that passed all checks, or a gap (``reason``), at bytes ``start`` to ``end``."""

    start: int
    end: int
    reason: str | None = None
    record_type: str | None = None
    record_id: str | None = None
    target_uri: str | None = None
    date: str | None = None
    refers_to: str | None = None
    payload_digest: str | None = None
    payload_bytes: int | None = None
    payload: bytes | None = None


class Damaged(Exception):
    """A check failed."""


class Open(Exception):
    """More bytes are needed to tell."""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower()] = value.strip()
    return fields


def _length(fields: dict[str, str], limit: int) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no content length")
    if (length := int(fields["content-length"])) > limit:
        raise Damaged("record beyond the limit")
    return length


def _checked(fields: dict[str, str], block: bytes, start: int, end: int) -> Found:
    """The record with its digests checked, which an unknown algorithm fails. The payload of an HTTP response
    is what follows its header."""

    def check(name: str, data: bytes) -> None:
        if name in fields:
            label, _, told = fields[name].partition(":")
            if label.lower() not in ("sha1", "sha256", "md5"):
                raise Damaged("digest unreadable")
            want = digest(data, label.lower())
            if told.upper() not in (want, want.rstrip("="), base64.b32decode(want).hex().upper()):
                raise Damaged(f"{name.split('-')[1]} digest differs")

    def inner(name: str) -> str | None:
        return fields[name].removeprefix("<").removesuffix(">") if name in fields else None

    kind = fields.get("warc-type")
    if not kind or "warc-record-id" not in fields:
        raise Damaged("no record type or id")
    check("warc-block-digest", block)
    payload, size = block, len(block)
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head, blank, payload = block.partition(END)
        if not blank:
            raise Damaged("HTTP header not ended")
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        size = int(told[1]) if told and kind == "revisit" else len(payload)
    if kind != "revisit":
        check("warc-payload-digest", payload)
    own = fields.get("warc-payload-digest", "").partition(":")[2] or None
    return Found(
        start, end, None, kind, inner("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"),
        inner("warc-refers-to"), own, size, None if kind == "revisit" else payload,
    )


class _Member:
    """A gzip member in the making, fed with the pieces between cuts."""

    def __init__(self, limit: int) -> None:
        self.limit, self.engine, self.out, self.held, self.fed = limit, zlib.decompressobj(wbits=31), [], 0, 0

    def feed(self, piece: bytes) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
        """(bytes of the member, its records), or Open."""
        self.fed += len(piece)
        try:
            more = True
            while more and not self.engine.eof:
                self.out.append(self.engine.decompress(piece, FLUSH))
                self.held += len(self.out[-1])
                piece = self.engine.unconsumed_tail
                more = piece or len(self.out[-1]) == FLUSH
                if self.held > self.limit + MAX_HEADER:
                    raise Damaged("record beyond the limit")
        except zlib.error:
            raise Damaged("member damaged") from None
        if not self.engine.eof:
            raise Open
        return self.fed - len(self.engine.unused_data), self._records(b"".join(self.out))

    def _records(self, data: bytes) -> list[tuple[dict[str, str], bytes]]:
        records, at = [], 0
        while at < len(data):
            ends = data.find(END, at)
            if ends < 0:
                raise Damaged("header not ended")
            fields = _fields(data[at:ends])
            start = ends + len(END)
            at = start + _length(fields, self.limit)
            if data[at:at + len(END)] != END:
                raise Damaged("length differs")
            records.append((fields, data[start:at]))
            at += len(END)
        return records


class _Plain:
    """A plain record in the making."""

    def __init__(self, limit: int) -> None:
        self.limit, self.pieces, self.fed, self.start, self.need, self.fields = limit, [], 0, 0, 0, None

    def feed(self, piece: bytes) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
        self.pieces.append(piece)
        self.fed += len(piece)
        if self.fields is None:
            data = b"".join(self.pieces)
            self.pieces = [data]
            ends = data.find(END)
            if ends < 0:
                if len(data) > MAX_HEADER:
                    raise Damaged("header not ended")
                raise Open
            self.fields, self.start = _fields(data[:ends]), ends + len(END)
            self.need = self.start + _length(self.fields, self.limit)
        if self.fed < self.need + len(END):
            raise Open
        data = b"".join(self.pieces)
        if data[self.need:self.need + len(END)] != END:
            raise Damaged("length differs")
        return self.need + len(END), [(self.fields, data[self.start:self.need])]


def scan(pieces: Iterable[bytes], mark: bytes, from_start: bool, to_end: bool, limit: int = LIMIT) -> Iterator[Found]:
    """Records and gaps of consecutive pieces, the bytes between cuts, each cut being ``mark``.

    With ``from_start`` the first piece has no mark ahead of it. Without ``to_end`` a record that is open at
    the last piece is given as a gap of reason "open". Pieces are held only while a record is open.
    """
    kind = _Member if mark == MEMBER else _Plain
    waiting: deque[tuple[int, bytes]] = deque()
    gap: Found | None = None
    at, trial, used = 0, None, 0

    def lost(start: int, end: int, reason: str) -> Iterator[Found]:
        nonlocal gap
        if gap and gap.end == start:
            gap = gap._replace(end=end)
        else:
            if gap:
                yield gap
            gap = Found(start, end, reason)

    def advance(done: bool) -> Iterator[Found]:
        nonlocal gap, trial, used
        while waiting:
            start, first = waiting[0]
            try:
                trial = trial or kind(limit)
                while True:
                    if used == len(waiting):
                        if not done:
                            return
                        raise Damaged("record not ended")
                    used += 1
                    try:
                        size, records = trial.feed(waiting[used - 1][1])
                        break
                    except Open:
                        continue
                found = [_checked(fields, block, start, start + size) for fields, block in records]
            except Damaged as problem:
                waiting.popleft()
                trial, used = None, 0
                yield from lost(start, start + len(first), str(problem))
                continue
            rest, piece = waiting[used - 1]
            for _ in range(used):
                waiting.popleft()
            trial, used = None, 0
            if gap and found:
                yield gap
                gap = None
            yield from found
            if start + size < rest + len(piece):
                yield from lost(start + size, rest + len(piece), "no record starts here")

    for number, piece in enumerate(pieces):
        if number == 0 and from_start:
            if piece:
                yield from lost(0, len(piece), "no record starts here")
            at = len(piece)
            continue
        waiting.append((at, mark + piece))
        at += len(mark) + len(piece)
        yield from advance(False)
    if waiting and not to_end:
        if gap:
            yield gap
        gap = Found(waiting[0][0], at, "open")
    else:
        yield from advance(True)
    if gap:
        yield gap


_ITEM = (
    "file string, block bigint, start bigint, end bigint, reason string, record_type string, record_id string, "
    "target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
)
_KINDS = [
    *[pa.string(), pa.int64(), pa.int64(), pa.int64()], *[pa.string()] * 7, pa.int64(), pa.binary(),
]
_NAMES = [part.split()[0] for part in _ITEM.split(", ")]


def _pieces(spark: SparkSession, folder: str, mark: bytes) -> DataFrame:
    """(file, block, block_end, file_size, at, value): the bytes between marks, in the order of ``at``."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("block_end"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("value"),
    )


def _scanned(pieces: DataFrame, mark: bytes, whole_files: bool, with_payload: bool, limit: int) -> DataFrame:
    """Records and gaps, by places from the start of their run of pieces; and one row of reason "run" per run,
    with the size of the file and the length of the run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            blocks = [0] * len(names) if whole_files else batch.column(1).to_pylist()
            yield from zip(zip(names, blocks, batch.column(2).to_pylist(), batch.column(3).to_pylist()), batch.column(4).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal rows, held
            columns = list(zip(*rows)) or [()] * len(_KINDS)
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)

        source = runs(batches)
        ahead = next(source, None)
        while ahead:
            name, block, block_end, file_size = ahead[0]
            length = 0

            def mine() -> Iterator[bytes]:
                nonlocal ahead, length
                first = block == 0
                while ahead and ahead[0][:2] == (name, block):
                    value = ahead[1]
                    length += len(value) + (0 if first else len(mark))
                    first = False
                    yield value
                    ahead = next(source, None)

            for found in scan(mine(), mark, block == 0, whole_files or block_end >= file_size, limit):
                rows.append((name, block, *(found if with_payload else found[:-1] + (None,))))
                held += len(found.payload or b"") + 300 if with_payload else 300
                if held > FLUSH:
                    yield packed()
            rows.append((name, block, file_size, length, "run", *[None] * 8))
        yield packed()

    return pieces.select("file", "block", "block_end", "file_size", "value").mapInArrow(run, _ITEM)


def read_archives(
    spark: SparkSession, folder: str, compressed: bool = True, with_payload: bool = True, limit: int = LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives in a folder, damaged ones included.

    Records: file, start, end, record_type, record_id, target_uri, date, refers_to, payload_digest (base32),
    payload_bytes and payload; a revisit has none, its bytes are those its HTTP header tells. Gaps: file,
    start, end, and the first failed check in them. Records and gaps cover every file without overlap.

    An empty file has neither. A record is held in memory whole; one of more than ``limit`` bytes is
    quarantined with that reason. A stretch without any mark must stay below 2 GB.
    """
    scratch = Scratch(prepare(spark), "archives")
    mark = MEMBER if compressed else VERSION
    pieces = _pieces(spark, folder, mark)
    items = scratch.store(_scanned(pieces, mark, False, with_payload, limit), "items")
    unsettled = scratch.store(items.filter("reason = 'open'").select("file").distinct(), "unsettled")
    if not unsettled.isEmpty():
        ordered = pieces.join(unsettled, "file", "left_semi").repartition("file").sortWithinPartitions("file", "block", "at")
        again = scratch.store(_scanned(ordered, mark, True, with_payload, limit), "again")
        items = items.join(unsettled, "file", "left_anti").select(items.columns).unionByName(again)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = items.filter("reason = 'run'").select("file", "block", F.col("start").alias("size"), F.col("end").alias("length"))
    bases = scratch.store(parts.withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0))), "bases")
    # a mark that ends a file has no piece after it
    tails = bases.groupBy("file").agg(F.sum("length").alias("start"), F.max("size").alias("end")).filter("start < end")
    placed = items.filter("reason IS NULL OR reason <> 'run'").join(bases.select("file", "block", "base"), ["file", "block"]).select(
        "file", (F.col("start") + F.col("base")).alias("start"), (F.col("end") + F.col("base")).alias("end"), *_NAMES[4:],
    )
    records = placed.filter("reason IS NULL").drop("reason")
    by_place = Window.partitionBy("file").orderBy("start")
    gaps = placed.filter("reason IS NOT NULL").select("file", "start", "end", "reason").unionByName(
        tails.withColumn("reason", F.lit("no record starts here"))
    )
    islands = gaps.withColumn("new", F.coalesce(F.col("start") != F.lag("end").over(by_place), F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(by_place))
    merged = islands.groupBy("file", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("reason", "start").alias("reason")
    )
    return records, merged.drop("island")


def op13_warc(spark, sf_dir):
    """All pages written as compressed archives in the shared folder and read back by the salvage reader."""
    pages = prepare(spark).read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{Scratch(spark, 'warc').folder}/archives"
    write_archives(revisits(pages), folder)
    records, _ = read_archives(spark, folder, with_payload=False)

    def page(name: str):
        return F.regexp_extract(name, f"^{PAGE}(-?[0-9]+)$", 1).try_cast("bigint")

    return records.filter("record_type IN ('response', 'revisit')").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"),
    )


OP13_SQL = """
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
    FROM pages),
base32 AS (
    SELECT *, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((cast('0x' || substr(hex, 1 + 5 * cast(floor(i / 4) AS bigint), 5) AS bigint) >> cast(15 - 5 * (i % 4) AS bigint)) & 31), 1)),
        'string_agg', '') AS payload_digest
    FROM page)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM base32"""
