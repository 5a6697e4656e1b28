"""Token-id files in Simple-8b: word-aligned blocks that decode with array operations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_onoma.llm.scratch import Scratch
from spark_onoma.llm.textops import U64, list_array
from spark_onoma.llm.tokenise import default_tokenizer, encoded

# Fixed values of the format: ids per word and bits per id of selectors 0 to 13; selector 15 is an escape.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
#: Values a block holds.
BLOCK = 1024
MAGIC = b"S8B1"


_WIDTH16 = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least; 61 for those that need an escape."""
    small = np.minimum(values, U64(0xFFFF)).astype(np.uint16)
    out = _WIDTH16[small]
    for i in (large,) if len(large := np.flatnonzero(values > U64(0xFFFF))) else ():
        rest, bits = values[i], np.full(len(i), 16, np.uint8)
        for shift in range(16, 61):
            bits[rest >> U64(shift) > 0] = shift + 1
        out[i] = bits
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard: header, words before each block, escapes before each block, words, escaped values."""
    values = np.ascontiguousarray(values, dtype=U64)
    n = len(values)
    blocks = -(-n // block)
    width = _widths(values)
    stop = np.minimum((np.arange(n) // block + 1) * block, n)
    left = np.minimum(stop - np.arange(n), 60).astype(np.uint8)
    choice = np.full(n, ESCAPE, np.uint8)
    high: dict[int, np.ndarray] = {1: width}

    def highest(k: int) -> np.ndarray:
        """The largest width of the k values from each place, or of those that are left."""
        if k not in high:
            half = 1 << ((k - 1).bit_length() - 1)
            part, out = highest(half), highest(half).copy()
            if n > k - half:
                out[: n - (k - half)] = np.maximum(out[: n - (k - half)], part[k - half :])
            high[k] = out
        return high[k]

    for s in reversed(range(14)):
        np.copyto(choice, s, where=(highest(PER_WORD[s]) <= BITS[s]) & (left >= PER_WORD[s]))
    step = np.append(np.array(PER_WORD, np.int64), [1, 1])[choice]
    at, lanes, spots = np.arange(blocks, dtype=np.int64) * block, np.arange(blocks), []
    end = np.minimum(at + block, n)
    while len(lanes):
        spots.append(at)
        at = at + step[at]
        live = at < end
        at, end, lanes = at[live], end[live], lanes[live]
    spot = np.sort(np.concatenate(spots)) if spots else np.zeros(0, np.int64)
    kind = choice[spot]
    words = kind.astype(U64) << U64(60)
    for s in range(14):
        own = np.flatnonzero(kind == s)
        if len(own):
            shift = (np.arange(PER_WORD[s]) * BITS[s]).astype(U64)
            words[own] |= np.bitwise_or.reduce(values[spot[own][:, None] + np.arange(PER_WORD[s])] << shift, axis=1)
    escaped = spot[kind == ESCAPE]
    first_word = np.searchsorted(spot, np.arange(blocks + 1) * block).astype("<u4")
    first_escape = np.searchsorted(escaped, np.arange(blocks + 1) * block).astype("<u4")
    rank = np.arange(len(escaped))
    words[kind == ESCAPE] |= (rank - first_escape[escaped // block]).astype(U64)
    head = MAGIC + np.array([n, block, len(words), len(escaped)], "<u8").tobytes()
    return head + first_word.tobytes() + first_escape.tobytes() + words.astype("<u8").tobytes() + values[escaped].astype("<u8").tobytes()


def decode(shard: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of a shard, or of the blocks from ``first_block`` to before ``last_block``."""
    if shard[:4] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    n, block, n_words, n_escapes = np.frombuffer(shard, "<u8", 4, 4).tolist()
    blocks = -(-n // block)
    last_block = blocks if last_block is None else min(last_block, blocks)
    first_block = min(first_block, last_block)
    at = 36
    first_word = np.frombuffer(shard, "<u4", blocks + 1, at).astype(np.int64)
    first_escape = np.frombuffer(shard, "<u4", blocks + 1, at + 4 * (blocks + 1)).astype(np.int64)
    at += 8 * (blocks + 1)
    words = np.frombuffer(shard, "<u8", n_words, at)[first_word[first_block] : first_word[last_block]]
    escaped = np.frombuffer(shard, "<u8", n_escapes, at + 8 * n_words)
    kind = (words >> U64(60)).astype(np.int64)
    size = np.append(np.array(PER_WORD, np.int64), [1, 1])[kind]
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), U64)
    for s in range(14):
        own = np.flatnonzero(kind == s)
        if len(own):
            shift = (np.arange(PER_WORD[s]) * BITS[s]).astype(U64)
            out[place[own][:, None] + np.arange(PER_WORD[s])] = (words[own][:, None] >> shift) & U64((1 << BITS[s]) - 1)
    own = np.flatnonzero(kind == ESCAPE)
    if len(own):
        number = np.searchsorted(first_word, own + first_word[first_block], "right") - 1
        out[place[own]] = escaped[first_escape[number] + (words[own] & U64((1 << 60) - 1)).astype(np.int64)]
    return out


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, ids, sizes in encoded(batch.column(1), path, end_id):
                small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)]) * small.itemsize
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(small.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)).cast(pa.int64()), pa.array(np.full(len(sizes), small.itemsize, np.int32)), raw], names=["doc_id", "width", "raw"])

    return run, "doc_id long, width int, raw binary"


def _shards(limit: int):
    """Sorted rows of a partition to shards of about ``limit`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            payload = encode(np.concatenate(parts))
            sizes = np.array([len(x) for x in parts])
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), list_array(pa.array(docs, pa.int64()), np.array([len(docs)]), pa.int64()), list_array(sizes, np.array([len(sizes)]), pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([payload], pa.binary())]
            number, held = number + 1, 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "shard", "doc_ids", "sizes", "n_ids", "payload"])

        for batch in batches:
            for doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(raw.as_buffer(), f"<u{width}"))
                held += len(parts[-1])
                if held >= limit:
                    yield flush()
        if docs:
            yield flush()

    return run, "part int, shard int, doc_ids array<long>, sizes array<long>, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shard_ids: int = 1 << 20) -> None:
    """Encode every text and write the ids in ascending ``doc_id`` order as Simple-8b shards.

    The shards are the ``payload`` column of Parquet files at ``path``, so any store that Spark writes to will do.
    Texts are dealt out by ranges of the id and encoded after that, once; each task holds one shard at a time. Null text counts as empty (the end
    id alone); null ids come first; repeated rows are written each.
    """
    run, schema = _tokens(tokenizer or default_tokenizer(), end_id)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    make, kinds = _shards(shard_ids)
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema).mapInArrow(make, kinds).write.parquet(path)


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    Only the id counts of shards (one row per 2**20 ids) are summed in order; payloads stay where they are.
    """
    shards = spark.read.schema("part int, shard int, doc_ids array<long>, sizes array<long>, n_ids long, payload binary").parquet(path)
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before_part = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("p0"))
    in_part = shards.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("s0"))
    starts = in_part.join(before_part, "part").select("part", "shard", (F.col("p0") + F.col("s0")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, sizes, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                values = decode(payload.as_buffer().to_pybytes()).astype("<u4")
                size = sizes.values.to_numpy()
                at = np.concatenate([[0], np.cumsum(size)])
                crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [docs.values, pa.array(first.as_py() + at[:-1]), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(list_array(values, size, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return shards.join(starts, ["part", "shard"]).select("first", "doc_ids", "sizes", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read each document's ids back from them."""
    path = f"{Scratch(docs.sparkSession, 'token-file').root}/shards"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)
