"""Language identification with a bidirectional gated recurrent network over bytes.

The network is fitted on the driver from at most SAMPLE_PER_LANGUAGE pieces of SAMPLE_CHARS characters per
language (the documented bound); prediction runs over every byte of every text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import gru
from tallyhouse.llm.shared import documents, lean, prepare

SAMPLE_PER_LANGUAGE = 250
SAMPLE_CHARS = 512
BLOCK = 2048
UNDETERMINED = "und"


def held_out() -> Column:
    """Documents never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, per_language: int, chars: int) -> list:
    """(lang, piece) rows: the documents whose hashed id is smallest, evenly for each language.

    A count per language turns the wanted number into a share of the hash range, so that only rows of
    the sample travel, whatever the size of the table.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    counts = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, count in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < 2.0 * per_language / count))
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.greatest(F.char_length("text") - chars, F.lit(1))) + 1
    drawn = (
        known.filter(wanted)
        .select("lang", place.alias("place"), "doc_id", F.substring("text", start.cast("int"), F.lit(chars)).alias("piece"))
        .orderBy("place", "doc_id", "piece")
        .limit(2 * per_language * max(1, len(counts)))
    )
    taken: dict[str, int] = {}
    sample = []
    for row in drawn.collect():
        if taken.setdefault(row["lang"], 0) < per_language:
            taken[row["lang"]] += 1
            sample.append((row["lang"], row["piece"]))
    return sample


def fit(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS, rounds: int = 160
) -> dict:
    """The fitted model; without any labelled text one that knows no language."""
    sample = [(lang, piece.encode()) for lang, piece in training_sample(docs, per_language, chars) if piece]
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return {"languages": [], "net": None}
    labels = np.array([languages.index(lang) for lang, _ in sample])
    net = gru.train([piece for _, piece in sample], labels, len(languages), rounds=rounds)
    return {"languages": languages, "net": net}


def score_texts(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of its positions' label probabilities, and how many positions got each label."""
    k = len(model["languages"])
    pooled, positions = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    grid, size, owner = gru.segments(texts)
    for start in range(0, len(grid), BLOCK):
        part = slice(start, start + BLOCK)
        p = gru.probabilities(model["net"], grid[part])
        p *= (np.arange(gru.SEGMENT)[:, None] < size[None, part])[..., None]
        top = p[..., 0].copy()
        for j in range(1, k):
            np.maximum(top, p[..., j], out=top)
        for j in range(k):
            pooled[:, j] += np.bincount(owner[part], p[..., j].sum(0), len(texts))
            labelled = ((p[..., j] == top) & (top > 0)).sum(0)
            positions[:, j] += np.bincount(owner[part], labelled, len(texts))
    pooled /= np.maximum(1, [len(t) for t in texts])[:, None]
    return pooled, positions


def _groups(texts: list[str], limit: int = 2 << 20) -> Iterator[slice]:
    """Rows of about ``limit`` characters together, which bounds the network's working memory; a longer text
    is a group of its own."""
    first, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text)
        if held > limit:
            yield slice(first, n + 1)
            first, held = n + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _judged(model: dict, texts: list[str]) -> tuple[list[str], list[float], list[list[int]]]:
    """Language, score and labelled positions per language of each text; ``und`` without a letter."""
    languages = model["languages"]
    lettered = [any(map(str.isalpha, text)) and bool(languages) for text in texts]
    chosen = [text.encode() for text, ok in zip(texts, lettered) if ok]
    pooled, positions = score_texts(model, chosen) if chosen else (np.zeros((0, 1)), None)
    at = iter(range(len(chosen)))
    langs, scores, counts = [], [], []
    for ok in lettered:
        if ok:
            row = next(at)
            best = int(pooled[row].argmax())
            langs.append(languages[best])
            scores.append(min(1.0, float(pooled[row][best])))
            counts.append([int(v) for v in positions[row]])
        else:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            counts.append([0] * len(languages))
    return langs, scores, counts


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, positions): language, pooled probability, labelled positions per language.

    A text that is null or has no letter is ``und`` with score 0. Rows are independent: repeated rows give
    repeated results, a null id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1).to_pylist()
            for part in _groups(values):
                langs, scores, counts = _judged(model, values[part])
                yield pa.RecordBatch.from_arrays(
                    [ids[part], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(counts, pa.list_(pa.int64()))],
                    names=["doc_id", "lang_pred", "score", "positions"],
                )

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double, positions array<bigint>")


def keep_known(docs: DataFrame, model: dict, least_score: float) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is in a known language with at least that score. Each row
    is judged where it is read, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [text or "" for text in batch.column("text").to_pylist()]
            for part in _groups(values):
                langs, scores, _ = _judged(model, values[part])
                kept = [lang != UNDETERMINED and score >= least_score for lang, score in zip(langs, scores)]
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(kept, pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.array_join("positions", ",").alias("positions"),
    )
