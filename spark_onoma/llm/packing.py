"""Cost-balanced packing of token ids into sequences of bounded length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.tokenise import default_tokenizer, encoded

#: Relative cost of a token's linear layers and of a token pair's attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Rests of documents that are packed together at a time.
POOL = 4096
#: Pieces of a record batch that goes back to Spark.
PIECES = 256


def pack_rests(lengths: list[int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) for items shorter than ``limit``.

    There are as many sequences as the tokens need, plus one padded end. Items go in descending order of their cost,
    a * n + b * n * n, to the sequence of the lowest cost among all that have room; one that fits nowhere is cut over those with
    the most room.
    """
    count = -(-sum(lengths) // limit)
    used, cost, out = [0] * count, [0.0] * count, []
    # Sequences by their tokens so far, each heap by cost; ``least`` has the cost of each heap's first.
    heaps: dict[int, list[tuple[float, int]]] = {0: [(0.0, s) for s in range(count)]}
    least = np.full(limit + 1, np.inf)
    least[0] = 0.0 if count else np.inf
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: (-lengths[i], i))
    late = []

    def put(item: int, start: int, n: int, s: int) -> None:
        out.append((item, start, n, s, used[s]))
        used[s] += n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for item in order:
        n = lengths[item]
        at = int(least[: limit - n + 1].argmin())
        if least[at] == np.inf:
            late.append(item)
            continue
        s = heapq.heappop(heaps[at])[1]
        least[at] = heaps[at][0][0] if heaps[at] else np.inf
        put(item, 0, n, s)
        heapq.heappush(heaps.setdefault(used[s], []), (cost[s], s))
        least[used[s]] = heaps[used[s]][0][0]
    room = sorted((s for s in range(count) if used[s] < limit), key=lambda s: (used[s], s))
    at = 0
    for item in late:
        start = 0
        while start < lengths[item]:
            n = min(limit - used[room[at]], lengths[item] - start)
            put(item, start, n, room[at])
            start += n
            at += used[room[at]] == limit
    return out


def packer(path: str, end_id: int, limit: int, with_ids: bool):
    """A mapInArrow function: id and text to pieces; each partition numbers its own sequences."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        made = 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        rests: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

        def piece(doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> tuple:
            return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, *([ids.astype(np.int32)] if with_ids else []))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            plan = pack_rests([len(r[2]) for r in rests], limit)
            for k in range(0, len(plan), PIECES):
                yield rows([piece(rests[i][0], rests[i][1] + start, rests[i][2][start : start + n], rests[i][3], base + made + s, at) for i, start, n, s, at in plan[k : k + PIECES]])
            made += max((x[3] for x in plan), default=-1) + 1
            rests.clear()

        for batch in batches:
            for first, _, ids, sizes in encoded(batch.column(1), path, end_id):
                found, at = [], 0
                for doc, total in zip(batch.column(0).slice(first, len(sizes)).to_pylist(), sizes.tolist(), strict=True):
                    own = ids[at : at + total]
                    at += total
                    whole = total - total % limit
                    for start in range(0, whole, limit):
                        found.append(piece(doc, start, own[start : start + limit], total, base + made, 0))
                        made += 1
                    if whole < total:
                        rests.append((doc, whole, own[whole:].copy(), total))
                        if len(rests) >= POOL:
                            yield from flush()
                    if len(found) >= PIECES:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)
        if rests:
            yield from flush()

    return pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limit: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most ``limit`` tokens, with their ids unless ``with_ids`` is off.

    Every partition packs its own rows: nothing is shuffled, a lost task is repeated alone with the same result, and
    memory holds at most ``POOL`` rests. Whole multiples of ``limit`` become sequences of their own; rests are
    balanced by cost. Only the last sequence of each pool is padded.

    Null text counts as empty: one piece with the end id. Null ids stay null; repeated rows are packed each; an empty
    table gives no row; other columns are ignored.
    """
    pack, schema = packer(tokenizer or default_tokenizer(), end_id, limit, with_ids)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pack, schema)
