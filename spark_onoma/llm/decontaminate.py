"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.textops import PLACE_CODE, U64, Words, buffers, chunks, map_whole, mix

# Fixed masks: a 1 is a word that must agree, a 0 one that may differ. A window of 26 words or more with the needed share
# has a shorter one with it, and in every window of 13 to 25 words these two meet, wherever its differing words stand.
MASKS = ("1111", "1110111")
#: An overlap has at least so many words (or all of a shorter item) of which so many agree.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: What a word that differs takes from a window's sum, if one that agrees adds 1 and a window of that share has 0.
_LOSS = -round(MIN_SHARE / (1 - MIN_SHARE))
#: Words of benchmark text that are sent to the executors at a time (about 60 bytes a word).
BLOCK_WORDS = 500_000
_FILTER_BITS = 24
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case, without ASCII punctuation at either end."""
    words = Words(data, offsets)
    for _ in range(3):
        longer = words.end - words.start > 1
        words.start = words.start + (longer & _PUNCT[words.data[words.start]])
        longer = words.end - words.start > 1
        words.end = words.end - (longer & _PUNCT[words.data[words.end - 1]])
    return words


def seeded(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash at each place of the words that a mask picks."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += hashes[j : j + n] * PLACE_CODE[j]
    return mix(out + U64(number + 1))


def short_parts(n: int) -> list[tuple[int, int]]:
    """Parts of an item of n words, one more than the words that may differ, so that one of them agrees whole."""
    parts = int(n * (1 - MIN_SHARE) + 1e-9) + 1
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        items = [x for x in items if len(x[1])]
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        keys, owner, place = [], [], []
        parts = [short_parts(len(w)) if len(w) < MIN_WORDS else [] for w in self.words]
        self.masks = list(MASKS) + ["1" * n for n in sorted({b - a for found in parts for a, b in found})]
        for number, mask in enumerate(self.masks):
            for i, w in enumerate(self.words):
                key = seeded(w, mask, number)
                at = np.arange(len(key))
                if len(w) < MIN_WORDS:
                    at = np.array([a for a, b in parts[i] if number >= len(MASKS) and b - a == len(mask)], np.int64)
                elif number >= len(MASKS):
                    continue
                keys.append(key[at])
                owner.append(np.full(len(at), i))
                place.append(at)
        every = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
        spot = (self.keys >> U64(64 - _FILTER_BITS)).astype(np.int64)
        np.bitwise_or.at(self.filter, spot >> 3, (1 << (spot & 7)).astype(np.uint8))

    def seeds(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, item, word of the item) of equal seeds."""
        for number, mask in enumerate(self.masks):
            key = seeded(hashes, mask, number)
            spot = (key >> U64(64 - _FILTER_BITS)).astype(np.int32)
            maybe = np.flatnonzero((self.filter[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
            low, high = np.searchsorted(self.keys, key[maybe], "left"), np.searchsorted(self.keys, key[maybe], "right")
            n = high - low
            if n.sum():
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield np.repeat(maybe, n), self.owner[at], self.place[at]

    def overlap(self, text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """(first word, words, agreeing words) of the window on a diagonal with most agreeing words, then fewest words.

        Windows are all those of ``MIN_WORDS`` words or more (or the whole of a shorter item) with the share
        ``MIN_SHARE``: a word that agrees gains 1 and one that differs loses 4, so such a window has no loss.
        """
        a, b = max(0, shift), min(len(text), shift + len(item))
        least = min(MIN_WORDS, len(item))
        if b - a < least:
            return None
        same = text[a:b] == item[a - shift : b - shift]
        gain, count = np.zeros(b - a + 1, np.int64), np.zeros(b - a + 1, np.int64)
        np.cumsum(np.where(same, 1, _LOSS), out=gain[1:])
        np.cumsum(same, out=count[1:])
        # For each end the first start without a loss is where the running minimum falls to the end's sum.
        start = np.searchsorted(-np.minimum.accumulate(gain), -gain)
        end = np.arange(b - a + 1)
        fit = np.flatnonzero(end - start >= least)
        if not len(fit):
            return None
        agree = count[fit] - count[start[fit]]
        best = int(fit[np.lexsort((fit - start[fit], -agree))[0]])
        first = int(start[best])
        while best - first > least and not same[first]:
            first += 1
        return a + first, best - first, int(count[best] - count[first])

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, first word, words, agreeing words) of a column of texts; one row per text, item and diagonal."""
        for first, _, data, offsets in chunks(column):
            words = bare_words(data, offsets)
            groups: set[tuple[int, int, int]] = set()
            for at, item, place in self.seeds(words.hash):
                for w, i, p in zip(at.tolist(), item.tolist(), place.tolist(), strict=True):
                    groups.add((int(words.doc[w]), i, w - p))
            for row, i, shift in groups:
                a, b = int(words.bounds[row]), int(words.bounds[row + 1])
                if found := self.overlap(words.hash[a:b], self.words[i], shift - a):
                    yield first + row, self.ids[i], *found


def indexes(benchmark: DataFrame) -> Iterator[Broadcast[Index]]:
    """The benchmark in blocks of a bounded number of words, broadcast one after another; the driver holds one at a time.

    Rows with null id or text are left out.
    """
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, -(-total // BLOCK_WORDS))

    def load(part: DataFrame) -> Index:
        rows = sorted((r["item_id"], r["text"]) for r in part.collect())
        words = bare_words(*buffers(pa.array([t for _, t in rows], pa.string())))
        return Index([(i, words.hash[a:b]) for (i, _), a, b in zip(rows, words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)])

    for k in range(count):
        yield sc.broadcast(load(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length, matches): overlaps of at least 13 words (or a whole shorter item), 80 % agreeing.

    Items of 1 to 12 words are searched whole: up to 4 words all must agree, of 5 to 9 one may differ, of 10 to 12 two.
    An item of a word or two so meets every text that has them; whoever does not want that leaves such items out.
    The benchmark is the query set: it goes over all documents in blocks of bounded size, and no document is shuffled.
    Null or empty texts have no overlap; rows that share an id are searched each and reported under that id, null ids too.
    An empty table on either side gives no row; other columns are ignored.
    """
    out = None
    for shared in indexes(benchmark):

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for row, item, start, size, agree in shared.value.hits(batch.column(1)):
                    best[row, item] = max(best.get((row, item), (0, 0, 0)), (agree, size, start))
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], i, start, size, agree) for (r, i), (agree, size, start) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "item_id", "start", "length", "matches"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(probe, "doc_id long, item_id long, start long, length long, matches long")
        out = part if out is None else out.unionByName(part)
    return out


def flag_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, kept, n_items, item_ids, max_overlap) for every document, null ids included."""
    found = contamination(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("length").alias("max_overlap"))
    out = docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left")
    hit = F.col("item_ids").isNotNull()
    return out.select("doc_id", hit.alias("contaminated"), (~hit).alias("kept"), F.when(hit, F.size("item_ids")).otherwise(0).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("max_overlap", F.lit(0).cast("long")).alias("max_overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, all columns kept, in one pass without a shuffle."""
    at = docs.columns.index("text")
    for shared in indexes(benchmark):

        def stay(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in shared.value.hits(batch.column(at)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = map_whole(docs, stay, docs.schema)
    return docs
