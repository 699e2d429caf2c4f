"""Personal data: base patterns, and identifiers of the same kinds discovered by bootstrapping.

The base patterns' matches are the seeds. The words before a match are a lexical pattern of its kind; a
pattern also precedes candidates, which look like an identifier of the kind but miss its base pattern
(a phone number without a plus sign, an address written with [at], an IPv6 address). Patterns and the
distinct values they precede form a graph. Spark scores it in rounds until it settles: a pattern is as good
as the values it precedes, a value as good as the patterns it follows. Candidates behind patterns of high
confidence become seeds themselves, which induce further patterns, and spans; the base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, documents, lean, prepare

KINDS = ("email", "ip", "card", "phone")
TOLERANCE = 0.005  # change of a confidence below which scoring has settled
MIN_CONFIDENCE = 0.9
MIN_SEEDS = 3
CONTEXT_WORDS = 2
LINE_MARK = "|"  # no word: ends a context that is the end of the line before

# fixed values: the base patterns
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# the same matches of the two patterns that would look at a long run again from each of its characters
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN_PART = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP_FROM_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
# shapes close to an identifier of each kind, which count only with evidence from their context
LOOSE = {
    "email": re.compile(r"(?<!\S)[A-Za-z0-9._%+-]{1,64}(?: ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9.])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
}
AT_MARK = re.compile(r"[\[(](?:at|AT)[\])]")
PATTERN_EDGE = re.compile(r"[^\w]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _accepted(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match.split("."))
    if kind == "card":
        digits = match.replace(" ", "").replace("-", "")
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= sum(map(str.isdigit, match)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: from each @ that a domain follows back to where the run ahead of it, or what
    the match before has left of it, begins."""
    runs, run, end = LOCAL_PART.finditer(text), None, 0
    for domain in DOMAIN_PART.finditer(text):
        at = domain.start()
        while run is None or run.end() < at:
            run = next(runs, None)
            if run is None:
                return
        start = max(run.start(), end)
        if run.end() == at and start < at:
            yield start, domain.end()
            end = domain.end()


def base_matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the leftmost non-overlapping matches of a base pattern, in time linear in the text."""
    if kind == "email":
        return _emails(text)
    pattern = IP_FROM_RUN if kind == "ip" else BASE[kind]
    return (match.span() for match in pattern.finditer(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, number of the kind, end) of all base matches, sorted; positions are code points."""
    found = []
    for number, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        found += [
            (start, number, end) for start, end in base_matches(kind, text) if _accepted(kind, text[start:end])
        ]
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that touch no base span."""
    found = []
    for number, kind in enumerate(KINDS):
        if kind == "email" and not AT_MARK.search(text) or kind == "ip" and text.count(":") < 7:
            continue
        for m in LOOSE[kind].finditer(text):
            if not any(start < m.end() and m.start() < end for start, _, end in base):
                found.append((m.start(), number, m.end()))
    return found


def _last_words(text: str, low: int, high: int) -> list[str]:
    """The last CONTEXT_WORDS words between two places. The stretch looked at grows until it has one word more,
    so that none is cut."""
    size = 80
    while True:
        start = max(low, high - size)
        words = [word for word in PATTERN_EDGE.split(text[start:high].lower()) if word]
        if start == low or len(words) > CONTEXT_WORDS:
            return [re.sub("[0-9]", "0", word) for word in words[-CONTEXT_WORDS:]]
        size *= 4


def context(text: str, start: int) -> str | None:
    """The words right before a position in its line, lower-cased and with digits as 0. Where none precede, as in
    a list with one entry a line, those that end the line before, told apart by a mark; None without."""
    line = text.rfind("\n", 0, start) + 1
    words = _last_words(text, line, start)
    if not words and line:
        words = _last_words(text, text.rfind("\n", 0, line - 1) + 1, line - 1)
        if words:
            words.append(LINE_MARK)
    return " ".join(words) or None


_SPAN = "struct<kind: string, start: int, end: int, pattern: string, value: string>"
_SPAN_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("value", pa.string()),
]))


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose) of every row: its base matches and candidates, each with the words before it."""

    def described(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
        return [
            {"kind": KINDS[kind], "start": start, "end": end, "pattern": context(text, start), "value": text[start:end].lower()}
            for start, kind, end in spans
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                base.append(described(text, found))
                loose.append(described(text, loose_spans(text, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(loose, _SPAN_TYPE)], names=["doc_id", "base", "loose"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id bigint, base array<{_SPAN}>, loose array<{_SPAN}>")


def good_patterns(edges: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, pattern, confidence) of the patterns whose confidence and support suffice, from ``edges``
    (kind, pattern, value, is_seed).

    A seed has score 1, a candidate starts with 0. A round gives each pattern the mean score of the distinct
    values it precedes, and each candidate the mean confidence of its patterns. A candidate behind a good
    pattern is accepted: from then on it is a seed as well, and supports patterns that precede no base match
    at all. Scores only grow, so the rounds end: when no confidence has changed by more than ``tolerance``.
    Means combine ahead of the shuffle, so a frequent pattern is no hot key.
    """
    scored = scratch.store(
        edges.groupBy("kind", "pattern", "value").agg(F.max("is_seed").cast("double").alias("score")), "graph-0"
    )
    patterns, n = None, 0
    while True:
        rated = scored.groupBy("kind", "pattern").agg(
            F.avg("score").alias("confidence"), F.count_if(F.col("score") == 1).alias("support")
        ).withColumn("good", (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SEEDS))
        if patterns is None:
            rated = rated.withColumn("change", F.lit(1.0))
        else:
            before = patterns.select("kind", "pattern", F.col("confidence").alias("before"))
            rated = rated.join(before.hint("merge"), ["kind", "pattern"]).withColumn("change", F.col("confidence") - F.col("before")).drop("before")
        patterns = scratch.store(rated, f"patterns-{n}")
        if patterns.filter(F.col("change") > tolerance).isEmpty():
            return patterns.filter("good").select("kind", "pattern", "confidence")
        values = (
            scored.filter("score < 1").join(patterns.hint("merge"), ["kind", "pattern"])
            .groupBy("kind", "value").agg(F.avg("confidence").alias("believed"), F.max("good").alias("accepted"))
        )
        after = scored.join(values.hint("merge"), ["kind", "value"], "left").select(
            "kind", "pattern", "value",
            F.when(F.col("accepted"), 1.0).otherwise(F.greatest(F.col("score"), F.coalesce("believed", F.lit(0.0)))).alias("score"),
        )
        n += 1
        after = scratch.store(after, f"graph-{n}")
        scratch.drop(f"graph-{n - 1}", *([f"patterns-{n - 2}"] if n > 1 else []))
        scored = after


def find_pii(docs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, base, found): spans of the base patterns, and spans that only their context gives away.

    Both are arrays of (kind, start, end) in code points, sorted by start and kind. A null text is empty.
    Rows are independent in the base spans: repeated rows give repeated results, a null id stays null. Every
    text is read once, whole, in time linear in its length.
    """
    scratch = Scratch(prepare(docs.sparkSession), "pii")
    rows = scratch.store(all_spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans")

    def exploded(column: str, seed: bool) -> DataFrame:
        spans = rows.select("row", F.explode(column).alias("span")).select("row", "span.*")
        return spans.filter(F.col("pattern").isNotNull()).withColumn("is_seed", F.lit(seed))

    loose = exploded("loose", False)
    edges = exploded("base", True).unionByName(loose).select("kind", "pattern", "value", "is_seed")
    patterns = good_patterns(edges, scratch, tolerance)
    found = (
        loose.join(patterns.hint("merge"), ["kind", "pattern"], "left_semi")
        .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    )
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    nothing = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return rows.join(found.hint("merge"), "row", "left").select(
        "doc_id", plain.alias("base"), F.coalesce("found", nothing).alias("found")
    )


def named(spans):
    """kind:start:end of each span by start, then kind in the order of KINDS, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    ))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(kind: str):
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("bigint")


def op8_pii(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir))
    counts = [number_of(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.concat("base", "found")).alias("spans"),
    )
