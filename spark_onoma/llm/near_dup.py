"""MinHash near-duplicate groups over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.graph import components, local_roots
from spark_onoma.llm.scratch import Scratch
from spark_onoma.llm.textops import U64, Words, chunks, grams, list_array, mix, shingle_sets, stream

HASHES = 168
SKETCH_LONGS = 8
#: A pair's signatures may differ by so many standard deviations more than the threshold expects.
SLACK = 4.2
#: Shingles (a member counts as ``MEMBER`` at least) on either side of a block of a bucket, which bounds a task's memory.
VOLUME, MEMBER = 2_000_000, 1000
#: Members up to which a bucket's open pairs are listed before they are confirmed; larger ones are counted in blocks.
LISTED = 16
#: The filter of ids whose sets are made has 16 bits an id; more ids than this (8 MB) are joined with the texts instead.
FILTER_IDS = 1 << 22
_COLUMNS, _DENSE = 256, 2048
#: Values of a block whose intersections are counted at a time, and members whose counts are held against the threshold at a time.
_SLICE, _STRIP = 1 << 18, 256


def band_rows(percent: int) -> int:
    """Most rows a band can have with a miss rate at the threshold of at most one in 100,000."""
    share = percent / 100
    return max(r for r in range(1, 13) if (1 - share**r) ** (HASHES // r) <= 1e-5)


def sketch_limit(percent: int) -> int:
    """Differing bits (3 for each hash) that a pair at the threshold hardly ever passes."""
    share = percent / 100
    unequal, spread = HASHES * (1 - share), HASHES * share * (1 - share)
    return int(1.5 * unequal + SLACK * (0.75 * unequal + 2.25 * spread) ** 0.5) + 1


def signer(words: int, percent: int):
    """A mapInArrow function: document id and text to set size, set fingerprint, band hashes and bit sketch."""
    rows = band_rows(percent)
    bands = HASHES // rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = stream(101, HASHES)[:, None] | U64(1), stream(202, HASHES)[:, None]
        place = stream(303, bands * rows).reshape(bands, rows) | U64(1)
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                n = last - first
                size, print1, print2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
                low = np.full((n, HASHES), np.iinfo(U64).max, dtype=U64)
                for row, x in shingle_sets(Words(data, offsets), words):
                    size[row] = len(x)
                    if len(x):
                        print1[row], print2[row] = mix(x).sum(dtype=U64), mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
                    for k in range(0, len(x), _COLUMNS):
                        y = factor * x[k : k + _COLUMNS]
                        y += shift
                        np.minimum(low[row], y.min(axis=1), out=low[row])
                low >>= U64(32)
                band = mix((low[:, : bands * rows].reshape(n, bands, rows) * place).sum(axis=2, dtype=U64)).view(np.int64)
                bits = ((low[:, :, None] >> np.arange(3, dtype=U64)) & U64(1)).astype(np.uint8).reshape(n, -1)
                packed = np.zeros((n, SKETCH_LONGS * 8), np.uint8)
                packed[:, : (bits.shape[1] + 7) // 8] = np.packbits(bits, axis=1)
                sketch = packed.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n).cast(pa.int64()), pa.array(size), pa.array(print1.view(np.int64)), pa.array(print2.view(np.int64)), list_array(band.ravel(), np.full(n, bands), pa.int64()), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_LONGS))],
                    names=["id", "n_shingles", "print1", "print2", "bands", *(f"s{k}" for k in range(SKETCH_LONGS))],
                )

    return sign, "id long, n_shingles long, print1 long, print2 long, bands array<long>, " + ", ".join(f"s{k} long" for k in range(SKETCH_LONGS))


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ids in 2**bits bits."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def set_maker(words: int, wanted=None):
    """A mapInArrow function: document id, filter place and text to the full set of shingle hashes of wanted ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                spot = batch.column(1).to_numpy()
                batch = batch.filter(pa.array((wanted.value[spot >> 6] >> (spot & 63)) & 1 == 1))
            for first, last, data, offsets in chunks(batch.column(2)):
                sets = [x for _, x in shingle_sets(Words(data, offsets), words)]
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), list_array(flat.view(np.int64), np.array([len(x) for x in sets]), pa.int64())], names=["id", "items"])

    return make, "id long, items array<long>"


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, items) of at least the distinct given ids; where a filter of them is small, no text is shuffled."""
    count = ids.count()
    docs, wanted, bits = docs.where("id is not null"), None, 20
    if count <= FILTER_IDS:
        bits = max(bits, (16 * count).bit_length())
        wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits))
    else:
        docs = docs.join(ids, "id", "left_semi")
    make, schema = set_maker(words, wanted)
    return docs.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("spot"), "text").mapInArrow(make, schema)


def _alike(x: str, y: str, percent: int) -> Column:
    """Do two full sets reach the threshold? Put so that the intersection is made once."""
    return (100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))


def _near_size(x: str, y: str, percent: int) -> Column:
    """May two sets of these sizes reach the threshold?"""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _unlike(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    parts = [F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH_LONGS)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    pairs = scratch.save(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = scratch.save(_sets(docs, ids, words))
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    found = pairs.join(left, "a").join(right, "b").where(_alike("x", "y", percent)).select("a", "b").distinct()
    links = scratch.save(found)
    scratch.drop(pairs, sets)
    return links


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another, as products of 0/1 matrices.

    The values are dealt by their low bits and a slice is worked on at a time, so what is needed beside the sets is small.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return out
    ends, flat = [np.cumsum([len(x) for x in side]) for side in (left, right)], [np.concatenate(side) for side in (left, right)]
    slices = min(1 << 16, 1 << ((len(flat[0]) + len(flat[1])) // _SLICE).bit_length())
    slots = [(values & values.dtype.type(slices - 1)).astype(np.uint16) for values in flat]
    for k in range(slices):
        places = [np.flatnonzero(slot == k) for slot in slots]
        _add_shared(out, [values[p] for values, p in zip(flat, places, strict=True)], [np.searchsorted(end, p, "right") for end, p in zip(ends, places, strict=True)])
    return out


def _add_shared(out: np.ndarray, values: list[np.ndarray], rows: list[np.ndarray]) -> None:
    """Add to ``out`` how many of these values, of either side's rows, two rows share."""
    _, column = np.unique(np.concatenate(values), return_inverse=True)
    cut = len(values[0])
    both = np.zeros(int(column.max(initial=-1)) + 1, np.int8)
    both[column[:cut]] = 1
    both[column[cut:]] |= 2
    number = np.cumsum(both == 3) - 1
    total = int(number[-1]) + 1 if len(number) else 0
    entries = []
    for row, part in zip(rows, (column[:cut], column[cut:]), strict=True):
        keep = both[part] == 3
        row, part = row[keep], number[part[keep]]
        order = np.argsort(part, kind="stable")
        entries.append((row[order], part[order]))
    for k in range(0, total, _DENSE):
        width = min(_DENSE, total - k)
        dense = []
        for side, (row, part) in enumerate(entries):
            a, b = np.searchsorted(part, [k, k + width])
            dense.append(np.zeros((out.shape[side], width), np.float32))
            dense[-1][row[a:b], part[a:b] - k] = 1
        out += dense[0] @ dense[1].T


def _linker(percent: int):
    """Members of a block of a bucket, those to be linked and all, to edges that join their parts."""

    def link(table: pa.Table) -> pa.Table:
        part, loose = table["part"].to_numpy(), table["loose"].to_numpy()
        items = table["items"].combine_chunks()
        flat, at = items.values.to_numpy(), items.offsets.to_numpy()
        rows = [np.flatnonzero(loose), np.flatnonzero(~loose)]
        if not len(rows[0]) or not len(rows[1]):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sides = [[flat[at[r] : at[r + 1]] for r in side] for side in rows]
        sizes = [np.array([len(x) for x in side]) for side in sides]
        names, number = np.unique(part, return_inverse=True)
        counts, links = shared_counts(*sides), []
        for k in range(0, len(counts), _STRIP):
            x, y = np.nonzero((100 + percent) * counts[k : k + _STRIP].astype(np.int64) >= percent * (sizes[0][k : k + _STRIP, None] + sizes[1][None, :]))
            # Of a strip's links only a spanning forest is kept.
            low = local_roots(len(names), [(number[rows[0][k + x]], number[rows[1][y]])])
            moved = np.flatnonzero(low != np.arange(len(names)))
            links.append((moved, low[moved]))
        root = names[local_roots(len(names), links)]
        found = np.flatnonzero(root != names)
        return pa.table({"a": names[found], "b": root[found]})

    return link, "a long, b long"


def _across_parts(many: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Edges that join the parts of buckets of any size: (bucket, id, part, n_shingles) to (a, b).

    Members outside a bucket's largest part are counted against all its members, so the work is their number times the
    bucket's, not its square. Both sides are dealt to blocks of bounded volume; a block sends back one edge a part at
    most, never its pairs.
    """
    many = scratch.save(many)
    weight = F.greatest("n_shingles", F.lit(MEMBER))
    parts = many.groupBy("bucket", "part").agg(F.struct(F.count(F.lit(1)).alias("n"), F.col("part").alias("main"), F.sum(weight).alias("volume")).alias("own"))
    plan = parts.groupBy("bucket").agg(F.max("own").alias("top"), F.sum("own.volume").alias("volume"))
    blocks = lambda volume: F.ceil(volume / VOLUME).cast("int")
    plan = plan.select("bucket", F.col("top.main").alias("main"), blocks(F.col("volume") - F.col("top.volume")).alias("rows"), blocks(F.col("volume")).alias("columns"))
    sets = scratch.save(_sets(docs, many.select("id").distinct(), words))
    dealt = many.join(plan, "bucket").withColumn("spot", F.xxhash64("id"))
    line = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = dealt.where("part <> main").select("bucket", "id", "part", F.lit(True).alias("loose"), F.pmod("spot", "rows").cast("int").alias("i"), F.explode(line("columns")).alias("j"))
    right = dealt.select("bucket", "id", "part", F.lit(False).alias("loose"), F.pmod(F.shiftright("spot", 20), "columns").cast("int").alias("j"), F.explode(line("rows")).alias("i"))
    link, schema = _linker(percent)
    found = scratch.save(left.unionByName(right).join(sets, "id").select("bucket", "i", "j", "part", "loose", "items").groupBy("bucket", "i", "j").applyInArrow(link, schema).distinct())
    scratch.drop(many, sets)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``. Equal sets are one class, so copies
    cost no pair. Classes meet in MinHash bands; each band bucket is first compared with its most central member only,
    sketches of 3 bits a hash screen the pairs, full sets confirm them, and large-star/small-star gives the components.
    Buckets that still hold several components then have their members compared across components: in small buckets each
    pair in the first band it shares, in larger ones everything outside the largest component with all members, in
    blocks. So no link is lost to a cap.

    Null or empty text has no shingle and links with nothing; texts shorter than ``words`` count as one shingle; rows
    with a null id are returned unlinked (null component, kept). Rows that share an id are one document, which links by
    any of its texts; each row is returned, those without a word as linked with nothing. Other columns of the input are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sign, schema = signer(words, percent)
    signed = scratch.save(docs.mapInArrow(sign, schema))
    # Written, so that the join back has two exchanges and a large group of copies can be split.
    classes = scratch.save(signed.where("n_shingles > 0 and id is not null").groupBy("print1", "print2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    node = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("node", "id"))
    members = scratch.save(signed.select("id", "n_shingles", "print1", "print2").join(classes, ["print1", "print2"], "left").select("id", "n_shingles", node.alias("node")))
    # A document with several texts joins the classes that they are in.
    texts = members.where("node is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.collect_set("node").alias("nodes")).where("low < high")
    twins = texts.select("id", F.explode(F.concat("nodes", F.array("id"))).alias("a"), F.col("low").alias("b")).where("a <> b").select("a", "b")
    nodes = members.where("id = node").select("id").distinct()
    heads = scratch.save(signed.where("n_shingles > 0").join(nodes, "id", "left_semi").drop("print1", "print2").dropDuplicates(["id", "bands"]))
    scratch.drop(signed, classes)

    entries = heads.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.col("band").cast("byte").alias("band"), F.xxhash64("band", "key").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.save(entries.join(sizes, "bucket"))
    rank = shared.groupBy("id").agg(F.sum("n").alias("rank"))
    centre = shared.join(rank, "id").groupBy("bucket").agg(F.max_by("id", F.col("rank") * 1024 + F.pmod(F.xxhash64("id"), F.lit(1024))).alias("centre"))
    sketches = heads.select("id", F.struct("n_shingles", *(f"s{k}" for k in range(SKETCH_LONGS))).alias("sketch"))
    limit = sketch_limit(percent)

    star = shared.join(centre, "bucket").where("id <> centre").select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()
    star = star.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").where(_near_size("x.n_shingles", "y.n_shingles", percent) & (_unlike("x", "y") <= limit)).select("a", "b")
    first = _confirmed(star, docs, words, percent, scratch)
    group = scratch.save(components(first, scratch))

    placed = scratch.save(shared.join(group.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("part")))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("bucket")
    open_rows = placed.join(mixed, "bucket").join(heads, "id")
    same_bucket = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & _near_size("x.n_shingles", "y.n_shingles", percent) & (_unlike("x", "y") <= limit)
    first_shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.col("x.band") + 1
    few = open_rows.where(F.col("n") <= LISTED)
    listed = few.alias("x").join(few.alias("y"), same_bucket & first_shared).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    second = _confirmed(listed, docs, words, percent, scratch)

    third = _across_parts(open_rows.where(F.col("n") > LISTED).select("bucket", "id", "part", "n_shingles"), docs, words, percent, scratch)
    merged = components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second).unionByName(third).unionByName(twins), scratch)

    out = members.join(merged.withColumnRenamed("component", "root"), "node", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("root", "node", "id").alias("component_id"))
    scratch.drop(heads, shared, placed, group, first, second, third)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, texts: DataFrame | None = None) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id; documents without words or id all stay.

    ``texts`` (doc_id, text) may give the texts to compare, several to a document if need be; ids that are not in
    ``docs`` may link others but are not counted as one that stays.
    """
    found = near_duplicates(docs if texts is None else texts, words, percent).where("doc_id is not null").select("doc_id", "component_id").distinct()
    found = found.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi") if texts is not None else found
    first = found.groupBy("component_id").agg(F.min("doc_id").alias("stays"))
    gone = found.join(first, "component_id").where("doc_id <> stays").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
