"""WARC archives: round trips, and salvage of damaged files against a reader that starts at the first byte."""

import gzip
import hashlib
import random
import zlib
from base64 import b32decode, b32encode
from pathlib import Path

import pytest
from check import twin_tables
from pyspark.sql import functions as F

from tallyhouse.llm import warc
from tallyhouse.llm.queries import QUERIES, SQL

SCHEMA = "page_id bigint, url string, html string, payload string, start string, file string"
INNER = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\ny"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, html, "p", "s", "f") for i, url, html in rows], SCHEMA)


ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (None, "http://a/n", "same"),
    (3, None, None), (4, "http://ü/\r\nx: y", ""), (5, "http://a/5", "ünï " * 60_000), (6, "http://a/6", INNER),
    (7, "http://a/7", "WARC/1.1\r\nWARC/1.0"), (None, None, "alone"), (-8, "u", "\r\n\r\n"),
]


def small_parts(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def parts(spark):
    yield lambda size: small_parts(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("size", ["128m", "50000"])
def test_round_trip(spark, parts, tmp_path, compressed, size):
    folder = f"{tmp_path}/archives"
    warc.write_archives(warc.revisits(pages(spark, ROWS).repartition(2)), folder, compressed)
    parts(size)
    records, gaps = warc.read_archives(spark, folder, compressed)
    assert gaps.count() == 0
    got = records.filter("record_type <> 'warcinfo'").collect()
    texts = {}
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).digest() == b32decode(r["payload_digest"])
            texts.setdefault(r["record_id"], []).append(r["payload"].decode())
    assert sorted(texts["urn:page:2"]) == ["same", "same"] and texts["urn:page:6"] == [INNER]
    assert texts["urn:page:5"] == ["ünï " * 60_000] and texts["urn:page:-8"] == ["\r\n\r\n"]
    turned = sorted((r["record_id"], r["refers_to"], r["payload_bytes"]) for r in got if r["record_type"] == "revisit")
    assert turned == [("urn:page:1", "urn:page:2", 4), ("urn:page:3", "urn:page:4", 0), ("urn:page:none", "urn:page:2", 4)]
    assert len(got) == len(ROWS)
    # records cover the files without overlap, but for what separates members
    for name in {r["file"] for r in got}:
        data = Path(name.removeprefix("file://").removeprefix("file:")).read_bytes()
        for r in records.filter(F.col("file") == name).collect():
            piece = data[r["start"]:r["end"]]
            assert piece.startswith(warc.MEMBER if compressed else warc.VERSION)
            assert not compressed or f"<{r['record_id']}>".encode() in gzip.decompress(piece)


def test_files_are_ordinary_gzip(spark, tmp_path):
    warc.write_archives(warc.revisits(pages(spark, ROWS).coalesce(1)), f"{tmp_path}/a")
    warc.write_archives(warc.revisits(pages(spark, ROWS).coalesce(1)), f"{tmp_path}/b", compressed=False)
    packed, flat = ([p.read_bytes() for p in Path(f"{tmp_path}/{n}").glob("part-*")] for n in "ab")
    assert sorted(map(gzip.decompress, packed)) == sorted(flat) and flat[0].count(b"WARC-Record-ID: <urn:page:") >= len(ROWS)


def sequential(data: bytes, mark: bytes, limit: int = warc.LIMIT):
    """(records, gaps) of one file by trying every byte in turn, written without the reader's parts."""
    def member(at):
        if not data.startswith(mark, at):
            return None
        if mark == warc.VERSION:
            body, size, out, need = data[at:], None, [], 1
        else:
            engine = zlib.decompressobj(wbits=31)
            try:
                body = engine.decompress(data[at:])
            except zlib.error:
                return None
            if not engine.eof:
                return None
            size, out, need = len(data) - at - len(engine.unused_data), [], None
        place = 0
        while place < len(body) and need != 0:
            head, blank, _ = body[place:].partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1") or any(":" not in x for x in lines[1:]):
                return None
            named = {x.partition(":")[0].strip().lower(): x.partition(":")[2].strip() for x in lines[1:]}
            if not named.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= set(named):
                return None
            start = place + len(head) + 4
            place = start + int(named["content-length"])
            block = body[start:place]
            if body[place:place + 4] != b"\r\n\r\n":
                return None
            place += 4
            if "warc-block-digest" in named and named["warc-block-digest"] != "sha1:" + b32encode(hashlib.sha1(block).digest()).decode():
                return None
            payload = block
            if named.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in block else None
            told = named.get("warc-payload-digest", "")
            if payload is None or told and named["warc-type"] != "revisit" and told[5:] != b32encode(hashlib.sha1(payload).digest()).decode():
                return None
            out.append(named["warc-record-id"].strip("<>"))
            need = need and need - 1
        return out, place if size is None else size

    records, gaps, at, lost = [], [], 0, None
    while at < len(data):
        got = member(at)
        if got is None:
            lost = at if lost is None else lost
            at += 1
            continue
        if lost is not None:
            gaps.append((lost, at))
            lost = None
        records += [(name, at, at + got[1]) for name in got[0]]
        at += got[1]
    return records, gaps + ([(lost, len(data))] if lost is not None else [])


def damage(data: bytes, pick: random.Random) -> bytes:
    """One of: bytes changed, cut out or put in, the head or the tail lost, a false mark put in."""
    at, kind = pick.randrange(len(data)), pick.randrange(7)
    if kind == 0:
        return data[:at] + bytes([data[at] ^ 1 << pick.randrange(8)]) + data[at + 1:]
    if kind == 1:
        return data[:at] + data[at + pick.randrange(1, 400):]
    if kind == 2:
        return data[:at] + pick.randbytes(pick.randrange(1, 200)) + data[at:]
    if kind == 3:
        return data[at:]
    if kind == 4:
        return data[:at]
    if kind == 5:
        return data[:at] + pick.choice([warc.MEMBER, warc.VERSION, warc.VERSION + b"1\r\nContent-Length: 99999\r\n\r\n"]) + data[at:]
    return data + pick.choice([warc.MEMBER, warc.VERSION, b"WARC/1.1\r\n\r\n"])


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("size", ["128m", "3000"])
def test_salvage(spark, parts, tmp_path, compressed, size):
    pick = random.Random(f"{compressed}{size}")
    rows = [(n, f"http://a/{n}", pick.choice(["short", INNER, "".join(pick.choices("abc <>\r\n", k=pick.randrange(900)))])) for n in range(30)]
    warc.write_archives(warc.revisits(pages(spark, rows).coalesce(1)), f"{tmp_path}/whole", compressed)
    data = next(Path(f"{tmp_path}/whole").glob("part-*")).read_bytes()
    Path(f"{tmp_path}/broken").mkdir()
    want_records, want_gaps = [], []
    mark = warc.MEMBER if compressed else warc.VERSION
    for n in range(20):
        broken = data
        for _ in range(n % 4):
            broken = damage(broken, pick)
        Path(f"{tmp_path}/broken/{n:02d}").write_bytes(broken)
        records, gaps = sequential(broken, mark)
        want_records += [(n, *record) for record in records]
        want_gaps += [(n, *gap) for gap in gaps]
    parts(size)
    records, gaps = warc.read_archives(spark, f"{tmp_path}/broken", compressed)
    number = F.substring("file", -2, 2).cast("int")
    got = sorted(tuple(r) for r in records.select(number, "record_id", "start", "end").collect())
    assert got == sorted(want_records)
    assert sorted(tuple(r) for r in gaps.select(number, "start", "end").collect()) == sorted(want_gaps)
    assert gaps.filter("reason IS NULL OR reason IN ('open', 'run')").count() == 0


def test_a_record_beyond_the_limit_is_quarantined(spark, tmp_path):
    for compressed in (True, False):
        folder = f"{tmp_path}/{compressed}"
        warc.write_archives(warc.revisits(pages(spark, ROWS).coalesce(1)), folder, compressed)
        records, gaps = warc.read_archives(spark, folder, compressed, limit=5000)
        assert {r["record_id"] for r in records.collect()} == {"urn:info", *(f"urn:page:{i}" for i in (1, 2, 3, 4, 6, 7, -8, "none"))}
        assert [r["reason"] for r in gaps.collect()] == ["record beyond the limit"]


def test_query_equals_sql(spark, tmp_path):
    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op13_warc"](spark, str(tmp_path))
    names = got.columns
    twin = twin_tables("/nowhere")
    twin.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = twin.execute(f"SELECT {', '.join(names)} FROM ({SQL['op13_warc']})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_no_page(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op13_warc"](spark, str(tmp_path)).count() == 0
