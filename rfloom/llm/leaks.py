"""Evaluation texts leaking into training text, found by spaced seeds.

Both sides are cut into words. Fixed masks over ``SPAN`` words ignore some
positions; the words at the others are hashed. A run of SPAN equal words is hit
under every mask, and one with substituted words under each mask that ignores
them: single words anywhere, and pairs 2, 3, 4, 5, 6 or 7 apart at the masks'
places (so also a text with every sixth word replaced). Hits are joined on the hash,
brought to (message, item, shift), and around each shift the words of both
sides are compared, as 64-bit hashes: the overlap is tolerant to
substitutions, the longest exact run is counted beside it.

The join is a broadcast one: the test side goes to the messages in blocks of
at most ``BROADCAST_SEEDS`` hashes (an item longer than that is a block of its
own). One block is the usual case, and the corpus is read once. With more, the
messages' word hashes are written once (8 bytes a word) and read once per
block; no window or message is ever shuffled, so no frequent phrase can make a
hot key. Whole messages are read, never prefixes.

Defined results: null or empty messages and items match nothing; items shorter
than SPAN words have no seed and can't be found; repeated messages or items
count once (items by id; different texts with one doc_id are each compared); a
message that shows a passage several times is one row per shift.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfloom.llm.mailtext import read_message
from rfloom.tables import written

SPAN = 12
#: 1: the word counts; 0: it is ignored.
MASKS = ("111011011111", "110111101011", "101110110111", "110111110111")
BROADCAST_SEEDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of positions, and compared words, that are held at a time.
_ROOM = 4_000_000
_RESULT = "doc_id bigint, item_id bigint, shift int, exact_run int, overlap int, equal_words int, item_words int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class _Hasher(dict):
    """Word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of each window of SPAN words under one mask."""
    n = len(hashes) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    value = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in (i for i, bit in enumerate(mask) if bit == "1"):
            value = (value ^ hashes[at : at + n]) * _MIX
            value ^= value >> np.uint64(29)
    return value


def hashed_texts(texts: list[list[str]], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts joined, words of each text)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.fromiter((hasher[w] for t in texts for w in t), np.uint64, int(sizes.sum())), sizes


def _windows(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seed hashes, their word positions in all texts joined) per mask, without windows across texts."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.nonzero(np.arange(len(flat)) + SPAN <= ends)[0]
    for k, mask in enumerate(MASKS):
        found = seeds(flat, mask, k)
        yield found[inside] if len(found) else found, inside


class Wanted:
    """One block of the test side: its items' words and all of their seeds, sorted."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        parts = list(_windows(self.words, self.sizes))
        seed, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(seed, kind="stable")
        self.seed, at = seed[order], at[order]
        self.item = np.repeat(np.arange(len(ids)), self.sizes)[at]
        self.at = at - self.first[self.item]
        # most windows of a corpus aren't wanted: a table of the hashes' last bits tells so at once
        self.bits = np.uint64((1 << min(24, max(10, 3 + len(seed).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.bits) + 1, bool)
        self.maybe[(self.seed & self.bits).astype(np.int64)] = True

    def hits(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift) with a common seed, as rows."""
        if not len(self.seed):
            return np.empty((0, 3), np.int64)
        owner, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        found = []
        for values, at in _windows(flat, sizes):
            some = np.nonzero(self.maybe[(values & self.bits).astype(np.int64)])[0]
            low = np.searchsorted(self.seed, values[some], "left")
            many = np.searchsorted(self.seed, values[some], "right") - low
            for a, b in _cuts(many):
                n = many[a:b]
                place = np.repeat(at[some[a:b]], n)
                which = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                text = owner[place]
                found.append(np.unique(np.stack([text, self.item[which], place - start[text] - self.at[which]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def compared(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, shift, exact run, overlap, equal words) of the hits of these texts."""
        found, start = self.hits(flat, sizes), np.cumsum(sizes) - sizes
        text, item, shift = found.T
        low = np.maximum(0, -shift)
        length = np.minimum(self.sizes[item], sizes[text] - shift) - low
        for a, b in _cuts(length + 1):
            t, i, s, n = text[a:b], item[a:b], shift[a:b], length[a:b]
            of = np.repeat(np.arange(b - a), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[a:b][of]
            same = flat[start[t][of] + place + s[of]] == self.words[self.first[i][of] + place]
            yield t, i, s, *stretches(same, n)


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbours with about _ROOM together, at least one each."""
    ends = np.nonzero(np.diff(np.cumsum(sizes) // _ROOM))[0] + 1
    edges = [0, *ends.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def stretches(same: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest run, words, equal words) of the best stretch of each comparison: +1 for an equal word, -2 for another."""
    # one place before each comparison, where its sums begin
    first = np.cumsum(lengths + 1) - (lengths + 1)
    change, equal = np.zeros(len(same) + len(lengths), np.int64), np.zeros(len(same) + len(lengths), np.int64)
    inside = np.ones(len(change), bool)
    inside[first] = False
    change[inside], equal[inside] = np.where(same, 1, -2), same
    places, which = np.arange(len(change)), np.repeat(np.arange(len(lengths)), lengths + 1)
    # each comparison lies far below the one before it, so a running minimum starts anew
    total = np.cumsum(change)
    level = total - total[first][which] - which * (3 * len(change) + 1)
    lowest = np.minimum.accumulate(level)
    since = np.maximum.accumulate(np.where(level == lowest, places, 0))
    gain = level - lowest
    best = np.maximum.reduceat(gain, first)
    at_best = np.nonzero(gain == best[which])[0]
    end = at_best[np.nonzero(np.diff(which[at_best], prepend=-1))[0]]
    counted = np.cumsum(equal)
    run = places - np.maximum.accumulate(np.where(equal == 0, places, 0))
    return np.maximum.reduceat(run, first), end - since[end], counted[end] - counted[since[end]]


def item_hashes(items: DataFrame) -> DataFrame:
    """item_id, words (hashes), n_seeds; one row per item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            words = [np.array([hasher[w] for w in words_of(t or "")], np.uint64).view(np.int64) for t in batch["item_text"].to_pylist()]
            seeded = [len(MASKS) * max(0, len(w) - SPAN + 1) for w in words]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(words, pa.list_(pa.int64())), pa.array(seeded, pa.int64())], ["item_id", "words", "n_seeds"])

    once = items.where("item_id is not null").groupBy("item_id").agg(F.max("item_text").alias("item_text"))
    return once.mapInArrow(cut, "item_id bigint, words array<bigint>, n_seeds bigint").where("n_seeds > 0")


def message_hashes(documents: DataFrame) -> DataFrame:
    """doc_id, words (hashes) of every message."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                flat, sizes = hashed_texts([words_of("\n".join(read_message(t)[1])) for t in part["text"].to_pylist()], hasher)
                words = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], words], ["doc_id", "words"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(cut, "doc_id bigint, words array<bigint>")


def _compared(messages: DataFrame, wanted: Wanted) -> DataFrame:
    """The overlaps of messages (doc_id, words) with one block of items."""
    shared = messages.sparkSession.sparkContext.broadcast(wanted)
    names = [field.split()[0] for field in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = pa.concat_arrays([part["words"]])
                sizes, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
                for text, item, *counts in block.compared(flat, sizes):
                    columns = [part["doc_id"].take(pa.array(text)), pa.array(block.ids[item]), *[pa.array(c.astype(np.int32)) for c in (*counts, block.sizes[item])]]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return messages.mapInArrow(run, _RESULT)


def _blocks(items: DataFrame, most: int) -> DataFrame:
    """items with ``block``: each has at most ``most`` seeds or a single item."""
    total = items.agg(F.sum("n_seeds")).first()[0] or 0
    count = max(1, -(-total // max(most, 1)))
    while True:
        blocked = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)))
        full = blocked.groupBy("block").agg(F.sum("n_seeds").alias("seeds"), F.count("*").alias("n")).where((F.col("seeds") > most) & (F.col("n") > 1))
        if count == 1 and total <= most or not full.take(1):
            return blocked
        count *= 2


def overlaps(documents: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, shift, exact_run, overlap, equal_words, item_words for every hit shift.

    ``overlap`` is the best stretch with at most one substitution per two equal
    words (+1 for an equal word, -2 for a substituted one).
    """
    blocked = _blocks(written(item_hashes(items), "items"), broadcast_seeds)
    numbers = sorted(r["block"] for r in blocked.select("block").distinct().toLocalIterator())
    messages = message_hashes(documents)
    if len(numbers) > 1:
        messages = written(messages, "words")
    found = None
    for number in numbers or [0]:
        rows = [(r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in blocked.where(F.col("block") == number).toLocalIterator()]
        part = _compared(messages, Wanted([r[0] for r in rows], [r[1] for r in rows]))
        if len(numbers) > 1:
            part = written(part, "overlaps")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leaks(documents: DataFrame, items: DataFrame, least_run: int = SPAN) -> DataFrame:
    """doc_id, item_id where the message shows at least ``least_run`` consecutive words of the item."""
    if least_run < SPAN:
        raise ValueError(f"runs below {SPAN} words need shorter masks")
    return overlaps(documents, items).where(F.col("exact_run") >= least_run).select("doc_id", "item_id").distinct()
