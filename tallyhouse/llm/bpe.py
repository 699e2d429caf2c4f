"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly if no merge
ever crosses from one token into the next, which depends on the two tokens alone; so all adjacent pairs
are checked at once, in numpy, on the merge trees of their tokens. Only words with a failing pair are
merged exactly: first the two tokens beside the failing border alone, whose outer borders are then checked
again, and the whole word where that does not settle it.

The vocabulary file is read on the driver; its tables, of the vocabulary's size, go to every task.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import documents, lean, prepare

END = "\n"  # stands for the word-end suffix; no byte is written as it
LAST = 0xE000  # letters from here on stand for a byte and the word end behind it
REPAIRS = 4  # rounds of encoding the tokens beside a failing border anew
SHORT = 48  # symbols up to which merging scans the list instead of keeping a heap
NEVER = np.int64(1) << 40
CACHED_WORDS = 250_000
AT_ONCE = 2 << 20  # characters encoded at once, or one longer text


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Merge trees of a vocabulary: the two parts and the rank of every token that a merge makes."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]) -> None:
        size = max(tokens.values()) + 1
        self.size = size
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = tokens[a + b]
            self.pairs[tokens[a], tokens[b]] = rank, made
            self.left[made], self.right[made], self.rank[made] = tokens[a], tokens[b], rank
        self.rank_of = {pair: rank for pair, (rank, _) in self.pairs.items()}
        keys = np.array([a * size + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ranks = np.array([rank for rank, _ in self.pairs.values()], dtype=np.int64)[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; NEVER where there is no such merge."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.key_ranks[at], NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, inner_only: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of each token pair before both tokens are complete.

        The piece at the right edge of ``a`` is at any time one of its right-most parts, that at the left
        edge of ``b`` one of its left-most parts; each lives until the merge that makes its parent. Of
        equal ranks the left one goes first. ``inner_only`` leaves out the merge of the tokens themselves.
        """
        found = np.zeros(len(a), dtype=bool)
        p, p_until = a.copy(), np.full(len(a), NEVER)
        depth = 0
        while (p >= 0).any():
            q, q_until = b.copy(), np.full(len(b), NEVER)
            inner = depth
            while (q >= 0).any():
                if inner or not inner_only:
                    rank = self.pair_rank(p, q)
                    found |= (rank < p_until) & (rank <= q_until) & (rank < NEVER)
                q_until = np.where(q >= 0, self.rank[q], NEVER)
                q = np.where(q >= 0, self.left[q], -1)
                inner += 1
            p_until = np.where(p >= 0, self.rank[p], NEVER)
            p = np.where(p >= 0, self.right[p], -1)
            depth += 1
        return found

    def whole(self) -> np.ndarray:
        """Whether encoding a token's own text gives that token."""
        made = np.flatnonzero(self.rank >= 0)
        broken = np.zeros(self.size, dtype=bool)
        broken[made] = self.crossed(self.left[made], self.right[made], inner_only=True)
        for token in made[np.argsort(self.rank[made])]:
            broken[token] |= broken[self.left[token]] or broken[self.right[token]]
        return ~broken

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols lowest rank first, of equal ranks the left-most."""
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        ids, never, ranks_of = list(ids), len(self.pairs), self.rank_of
        ranks = [ranks_of.get(pair, never) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            ids[at:at + 2] = [self.pairs[ids[at], ids[at + 1]][1]]
            del ranks[at]
            if at:
                ranks[at - 1] = ranks_of.get((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = ranks_of.get((ids[at], ids[at + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        ids, gone = list(ids), [False] * len(ids)
        heap = [(*self.pairs[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.pairs]
        heap = [(rank, i, made, pair) for rank, made, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = -1 if gone[i] else after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], gone[j], after[i] = made, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (new := (ids[a], ids[b])) in self.pairs:
                    rank, token = self.pairs[new]
                    heapq.heappush(heap, (rank, a, token, new))
        return [token for token, dead in zip(ids, gone) if not dead]


def _gathered(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches numbered ``at`` of a flat array, one after the other, and where each of them ends."""
    size = sizes[at]
    stop = np.cumsum(size)
    return flat[np.repeat(ends[at] - stop, size) + np.arange(int(size.sum()))], stop


class Tokenizer:
    """Encoder and decoder made from the text of a vocabulary file with word ends and lower-casing."""

    def __init__(self, file_text: str) -> None:
        file = json.loads(file_text)
        model, suffix = file["model"], file["model"]["end_of_word_suffix"]
        parts = {step["type"]: step for step in file["pre_tokenizer"]["pretokenizers"]}
        if model["type"] != "BPE" or not suffix or not parts["Split"]["invert"]:
            raise ValueError("the vocabulary must be a BPE with word ends, split into matches of a pattern")

        def inner(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) else token

        self.special = {token["content"]: token["id"] for token in file["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(parts["Split"]["pattern"]["Regex"])
        self.ids = {inner(token): number for token, number in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(self.ids, [(inner(a), inner(b)) for a, b in merges])
        names = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, number in {**model["vocab"], **self.special}.items():
            names[number] = token
        self.names = pa.array(names, pa.string())
        whole = self.merges.whole()
        self.letters = dict(enumerate(byte_letters()))
        self.last = {letter: chr(LAST + n) for n, letter in self.letters.items()}
        self.symbols: dict[str, int] = {}
        self.proposals = ahocorasick.Automaton()
        self.sizes, self.spelling = np.zeros(self.merges.size, np.int64), [""] * self.merges.size
        for token, number in self.ids.items():
            # the last letter of a word and its end mark are one symbol
            token = token[:-2] + self.last[token[-2]] if token.endswith(END) and len(token) > 1 else token
            self.sizes[number], self.spelling[number] = len(token), token
            if len(token) == 1:
                self.symbols[token] = number
            if whole[number]:
                self.proposals.add_word(token, number)
        self.proposals.make_automaton()
        self.seen = self.failed = 0  # words encoded, and those among them that had to be merged
        self._forget()

    def _forget(self) -> None:
        """Chunks seen by this process: the number of each, and where its ids stand in the flat array."""
        self.known: dict[str | int, int] = {}
        self.joins: dict[int, list[int]] = {}
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, the word each is of, words that they do not cover): greedy longest match over all words.

        Only the last symbol of a word is a last letter, so no match crosses from one word into the next.
        """
        found = list(self.proposals.iter_long("".join(words)))
        ends, tokens = (np.fromiter(column, np.int64, len(found)) for column in (zip(*found) if found else ((), ())))
        borders = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.searchsorted(borders, ends, side="right")
        covered = np.bincount(owner, self.sizes[tokens], len(words))
        return tokens, owner, np.flatnonzero(covered != np.diff(borders, prepend=0))

    def _crossed(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Places of the tokens whose border to the next one in the word is crossed by a merge."""
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(tokens[inside] * self.merges.size + tokens[inside + 1], return_inverse=True)
        return inside[self.merges.crossed(keys // self.merges.size, keys % self.merges.size)[back]]

    def _joined(self, key: int) -> list[int]:
        """The encoding of two tokens' letters; met again in other words, it is looked up."""
        if key not in self.joins:
            letters = self.spelling[key // self.merges.size] + self.spelling[key % self.merges.size]
            self.joins[key] = self.merges.merge([self.symbols[letter] for letter in letters])
        return self.joins[key]

    def _repaired(self, tokens: np.ndarray, owner: np.ndarray, crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens at every crossed border encoded anew; of borders in a row every other one."""
        run = np.flatnonzero(np.diff(crossed, prepend=-2) > 1)
        place = np.arange(len(crossed)) - np.repeat(run, np.diff(run, append=len(crossed)))
        chosen = crossed[place % 2 == 0]
        keys, back = np.unique(tokens[chosen] * self.merges.size + tokens[chosen + 1], return_inverse=True)
        joined = [self._joined(key) for key in keys.tolist()]
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        new, _ = _gathered(np.fromiter(chain.from_iterable(joined), np.int64), np.cumsum(sizes), sizes, back)
        counts, changed = np.ones(len(tokens), np.int64), np.zeros(len(tokens), bool)
        counts[chosen], counts[chosen + 1], changed[chosen] = sizes[back], 0, True
        out, fresh = np.repeat(tokens, counts), np.repeat(changed, counts)
        out[fresh] = new
        return out, np.repeat(owner, counts)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each word has); a word is its byte letters, the last one as a last letter.

        Where a border fails, the two tokens beside it are encoded anew and the borders of their word are
        checked again; a word that still fails after REPAIRS rounds is merged from its letters.
        """
        tokens, owner, uncovered = self.propose(words)
        merged_whole = np.zeros(len(words), bool)
        merged_whole[uncovered] = True
        done, unsure = [], ~merged_whole[owner]
        tokens, owner = tokens[unsure], owner[unsure]
        for n in range(REPAIRS + 1):
            crossed = self._crossed(tokens, owner)
            failing = np.zeros(len(words), bool)
            failing[owner[crossed]] = True
            fails = failing[owner]
            done.append((tokens[~fails], owner[~fails]))
            if n == 0:
                self.seen, self.failed = self.seen + len(words), self.failed + int((failing | merged_whole).sum())
            if n == REPAIRS or not len(crossed):
                break
            crossed = np.cumsum(fails)[crossed] - 1
            tokens, owner = self._repaired(tokens[fails], owner[fails], crossed)
        merged_whole |= failing
        rest = np.flatnonzero(merged_whole).tolist()
        merged = [self.merges.merge([self.symbols[letter] for letter in words[n]]) for n in rest]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        done.append((np.fromiter(chain.from_iterable(merged), np.int64), np.repeat(rest, sizes).astype(np.int64)))
        tokens, owner = (np.concatenate(parts) for parts in zip(*done))
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def spell(self, chunk: str) -> list[str]:
        """The words of a chunk without blanks, in byte letters, the last one as a last letter."""
        last = self.last
        if chunk.isascii() and chunk.isalpha():
            return [chunk[:-1] + last[chunk[-1]]]
        return [
            word[:-1] + last[word[-1]]
            for word in (
                part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
                for part in self.pattern.findall(chunk)
            )
        ]

    def learn(self, new: list[str | int]) -> None:
        """Encode chunks and remember them; a number is the id of a special token."""
        spelled = [(chunk,) if isinstance(chunk, int) else self.spell(chunk) for chunk in new]
        words = list(dict.fromkeys(chain.from_iterable(spelled)))
        place = {word: n for n, word in enumerate(words)}
        plain = [word for word in words if isinstance(word, str)]
        flat, counts = self.encode_words(plain)
        special = np.array([isinstance(word, int) for word in words], bool)
        sizes = np.ones(len(words), np.int64)
        sizes[~special] = counts
        values = np.empty(int(sizes.sum()), np.int64)
        values[np.repeat(special, sizes)] = [word for word in words if isinstance(word, int)]
        values[np.repeat(~special, sizes)] = flat
        used = np.fromiter(map(place.__getitem__, chain.from_iterable(spelled)), np.int64)
        per_chunk = np.fromiter(map(len, spelled), np.int64, len(new))
        picked, ends = _gathered(values, np.cumsum(sizes), sizes, used)
        at = np.concatenate([[0], ends])[np.cumsum(per_chunk)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + at])
        self.flat = np.concatenate([self.flat, picked.astype(np.int32)])

    def chunks(self, text: str) -> list[str | int]:
        """The normalised text cut at blanks; a special token is its id."""
        if self.special_pattern is None or "<|" not in text:
            return self._plain(text)
        out: list[str | int] = []
        for n, piece in enumerate(self.special_pattern.split(text)):
            if n % 2:
                out.append(self.special[piece])
            else:
                out.extend(self._plain(piece))
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            # lower-casing letter by letter knows no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(mark in text for mark in "\x1c\x1d\x1e\x1f"):
            return [chunk for chunk in regex.split(r"\s+", text) if chunk]
        return text.split()

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        per_text = [self.chunks(text) for text in texts]
        every = list(chain.from_iterable(per_text))
        wanted = set(every)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self._forget()
            new = wanted
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        picked, ends = _gathered(self.flat, self.ends[1:], np.diff(self.ends), at)
        per = np.concatenate([[0], np.cumsum([len(chunks) for chunks in per_text])]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[per]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(picked, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The tokens of each id list, joined by blanks, special ones included."""
        ids = ids.fill_null([]) if ids.null_count else ids
        named = pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values))
        return pc.binary_join(named, " ")


@lru_cache(maxsize=2)
def _tokenizer(file_text: str) -> Tokenizer:
    return Tokenizer(file_text)


def _shared(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return prepare(docs.sparkSession).sparkContext.broadcast(file.read())


def _groups(sizes: list[int], limit: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows of about ``limit`` together."""
    first, held = 0, 0
    for n, size in enumerate(sizes):
        if held and held + size > limit:
            yield first, n - first
            first, held = n, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids``: its encoding under the vocabulary file at ``path``.

    A null or empty text has no ids. Rows are independent of each other. A column named ids is replaced.
    """
    vocabulary = _shared(docs, path)
    rest = [name for name in docs.columns if name not in (text, "ids")]
    source = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("text_to_encode"))
    schema = "".join(f"{field.simpleString().replace(field.name, f'`{field.name}`', 1)}, " for field in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary.value)
        for whole in batches:
            for first, number in _groups(pc.binary_length(whole.column(len(rest))).to_pylist()):
                batch = whole.slice(first, number)
                ids = tokenizer.encode(batch.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*rest, "ids"])

    return source.mapInArrow(lean(run), schema + "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text its ``ids`` stand for; no ids give the empty text."""
    vocabulary = _shared(encoded, path)
    columns = [name for name in encoded.columns if name not in ("ids", "decoded")]
    source = encoded.select(*columns, "ids")
    schema = "".join(f"{field.simpleString().replace(field.name, f'`{field.name}`', 1)}, " for field in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary.value)
        for whole in batches:
            lengths = pc.list_value_length(whole.column(len(columns))).fill_null(0).to_pylist()
            for first, number in _groups(lengths):
                batch = whole.slice(first, number)
                ids = pa.concat_arrays([batch.column(len(columns))])
                ids = pa.array(ids.to_pylist(), pa.list_(pa.int32())) if ids.offset else ids
                yield pa.RecordBatch.from_arrays([*batch.columns, tokenizer.decode(ids)], names=[*columns, "ids", "decoded"])

    return source.mapInArrow(lean(run), schema + "decoded string")


def public_vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir, path: str | None = None):
    path = path or public_vocabulary("word_bpe_49k.json")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
