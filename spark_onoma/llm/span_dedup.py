"""Substring deduplication over sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.scratch import Scratch
from spark_onoma.llm.textops import U64, Words, chunks, mix

RUN = 3
MIN_WORDS = 12
#: Of so many words in a row at least one ends a unit. With 8, any 47 words in a row that two texts share hold a common run of
#: three units and twelve words: ends are alike from the eighth word of a passage to the ninth from its end.
WINDOW = 8


def units(words: Words) -> np.ndarray:
    """First words of the sentence units of a chunk, each inside one row.

    A unit ends at a word that ends in . ! ? or before a line feed, and where ``WINDOW`` words in a row hold no such end, at
    those of the least hash among them. So the words around a place alone decide on it, whatever stands farther away.
    """
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    last = words.data[words.end - 1]
    line = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(words.data == 10, out=line[1:])
    ends = (last == 46) | (last == 33) | (last == 63)
    ends[:-1] |= (line[words.start[1:]] > line[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
    ends[-1] = True
    if (m := n - WINDOW + 1) > 0:
        before = np.zeros(n + 1, np.int64)
        np.cumsum(ends, out=before[1:])
        bare = before[WINDOW:] == before[:m]
        least = words.hash[:m].copy()
        for j in range(1, WINDOW):
            np.minimum(least, words.hash[j : j + m], out=least)
        for j in range(WINDOW):
            ends[j : j + m] |= bare & (words.hash[j : j + m] == least)
    return np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])


def runs(words: Words, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit starts as words, first unit, units, hash) of the shortest run from each unit with ``run`` units and ``min_words`` words."""
    first = units(words)
    n = len(first)
    if not n:
        return first, first, first, np.zeros(0, U64)
    total = len(words.start)
    place = np.cumprod(np.full(total + 1, 0x9E3779B97F4A7C15 | 1, U64), dtype=U64)
    back = np.cumprod(np.full(total + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), U64), dtype=U64)
    prefix = np.zeros(total + 1, U64)
    np.cumsum(words.hash * place[:total], out=prefix[1:])
    border = np.append(first, total)
    k = np.maximum(np.arange(n) + run, np.searchsorted(border, first + min_words))
    whole = k <= n
    unit = np.flatnonzero(whole)
    unit = unit[words.doc[first[unit]] == words.doc[border[k[unit]] - 1]]
    a, b = border[unit], border[k[unit]]
    return first, unit, k[unit] - unit, mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(U64))


def _spans(run: int, min_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                starts, unit, size, key = runs(words, run, min_words)
                if not len(unit):
                    continue
                row = words.doc[starts[unit]]
                base = np.searchsorted(words.doc[starts], np.arange(last - first))
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array((unit - base[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64))], names=["id", "unit", "size", "span"])

    return find, "id long, unit int, size int, span long"


def _cutter(run: int, min_words: int):
    """Text and the later spans of each row to the text without their sentences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                n = last - first
                words = Words(data, offsets)
                starts, unit, size, key = runs(words, run, min_words)
                doc = words.doc[starts] if len(starts) else np.zeros(0, np.int64)
                base = np.searchsorted(doc, np.arange(n + 1))
                gone = np.zeros(len(starts) + 1, np.int64)
                if len(unit):
                    order = np.lexsort((unit, key, doc[unit]))
                    again = order[1:][(key[order[1:]] == key[order[:-1]]) & (doc[unit[order[1:]]] == doc[unit[order[:-1]]])]
                    np.add.at(gone, unit[again], 1)
                    np.add.at(gone, unit[again] + size[again], -1)
                marks = batch.column(2).slice(first, n)
                for row, spans in enumerate(marks):
                    for s in spans.values if spans.is_valid else ():
                        u, k = s["unit"].as_py() + base[row], s["size"].as_py()
                        gone[u] += 1
                        gone[u + k] -= 1
                drop = np.cumsum(gone)[:-1] > 0
                texts, removed, lost = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
                raw, border = data.tobytes(), np.append(starts, len(words.start))
                for row in range(n):
                    a, b = int(base[row]), int(base[row + 1])
                    own = raw[offsets[row] : offsets[row + 1]]
                    if drop[a:b].any():
                        removed[row] = int(drop[a:b].sum())
                        lost[row] = int((border[a + 1 : b + 1] - border[a:b])[drop[a:b]].sum())
                        edge = np.append(words.start[starts[a:b]], offsets[row + 1])
                        edge[0] = offsets[row]
                        own = b"".join(raw[edge[i] : edge[i + 1]] for i in range(b - a) if not drop[a + i])
                    texts.append(own.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(texts, pa.string()), pa.array((base[1:] - base[:-1]).astype(np.int64)), pa.array(removed), pa.array(lost), batch.column(3).slice(first, n)], names=["doc_id", "text", "n_sentences", "n_removed", "n_words_removed", "first_doc_ids"])

    return cut, "doc_id long, text string, n_sentences long, n_removed long, n_words_removed long, first_doc_ids array<long>"


def drop_repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, n_words_removed, first_doc_ids): texts without repeated runs of sentences.

    Every run of at least ``run`` sentences and ``min_words`` words is hashed (words, ASCII case folded). A sentence
    goes if a run that covers it stands in a document with a smaller id, or earlier in its own. Only hashes and ids are
    shuffled to find them; first documents are minima with map-side aggregation, and the join back may be split.

    Null text counts as empty; an empty text stays so. Rows with a null id lose only repeats of their own; rows that
    share an id are one document, cut alike. An empty table gives no row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    find, schema = _spans(run, min_words)
    spans = docs.where("id is not null").mapInArrow(find, schema)
    firsts = spans.groupBy("span").agg(F.min("id").alias("first_doc"), F.max("id").alias("last_doc")).where("first_doc < last_doc").select("span", "first_doc")
    # Written, so that the join back has exchanges of its own and the partition of a very common span can be split.
    firsts = Scratch(docs.sparkSession, "spans").save(firsts)
    later = spans.join(firsts, "span").where("id > first_doc")
    marks = later.groupBy(F.col("id").alias("mark_id")).agg(F.collect_set(F.struct("unit", "size")).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids"))
    cut, kinds = _cutter(run, min_words)
    return docs.join(marks, F.col("id") == F.col("mark_id"), "left").select("id", "text", "spans", "first_doc_ids").mapInArrow(cut, kinds)
