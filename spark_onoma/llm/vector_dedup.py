"""Embedding near-duplicates by collision counting over one-dimensional projections."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.graph import components, local_roots
from spark_onoma.llm.scratch import Scratch

PROJECTIONS = 48
#: Share of pairs at the threshold that must pass the collision count.
RECALL = 0.999
#: Vectors of a label that one task compares with as many others.
BLOCK = 2048
_TILE = 256


@lru_cache(maxsize=8)
def projections(dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, PROJECTIONS)).astype(np.float32)


def calibrated(cosine: float) -> tuple[float, int]:
    """(half width of a query's window, collisions needed) for RECALL at the threshold.

    The gap of a pair in a Gaussian projection is normal with deviation |u - v|; one deviation is the window.
    """
    width = sqrt(2 - 2 * cosine)
    p = erf(1 / sqrt(2))
    passed, need = 0.0, PROJECTIONS + 1
    while passed < RECALL:
        need -= 1
        passed += comb(PROJECTIONS, need) * p**need * (1 - p) ** (PROJECTIONS - need)
    return width * 1.0001, need


def collisions(queries: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """Per (query, point) the number of projections in whose sorted order the point lies in the query's window."""
    count = np.zeros((len(queries), len(points)), np.int8)
    places = np.arange(len(points))
    for p in range(queries.shape[1]):
        order = np.argsort(points[:, p], kind="stable")
        line = points[order, p]
        rank = np.empty(len(points), np.int32)
        rank[order] = places
        low = np.searchsorted(line, queries[:, p] - width, "left").astype(np.int32)
        high = np.searchsorted(line, queries[:, p] + width, "right").astype(np.int32)
        count += (rank[None, :] - low[:, None]).view(np.uint32) < (high - low)[:, None].view(np.uint32)
    return count


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label linked when their cosine reaches the threshold.

    A label's vectors are dealt to blocks of about ``BLOCK`` by a hash; a task sorts the projections of one block,
    counts each query's window collisions and verifies pairs that pass the calibrated count in double precision. It
    returns a link count and one edge to the smallest member of its local component per linked vector, never the pairs.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link with
    nothing and are returned; vectors of other lengths are never compared. Rows that share an id do not link with each
    other; their links are added up and each row has the sum. An empty table gives no row; other columns are ignored. Cosines are compared as they
    are rounded in double precision, so a pair exactly at the threshold may fall on either side of it.
    """
    scratch = Scratch(vectors.sparkSession, "near-vectors")
    width, need = calibrated(cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dims", F.size("v"))
    counts = good.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = good.join(counts, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        line = (v.astype(np.float32) @ projections(v.shape[1])).astype(np.float32)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        degree, links = np.zeros(len(ids), np.int64), []
        for k in range(0, len(left), _TILE):
            a, b = left[k : k + _TILE], right if i != j else right[k:]
            if not len(b):
                break
            q, p = np.nonzero(collisions(line[a], line[b], width) >= need)
            q, p = a[q], b[p]
            keep = ids[q] != ids[p] if i != j else (q < p) & (ids[q] != ids[p])
            q, p = q[keep], p[keep]
            for m in range(0, len(q), 65536):
                x, y = q[m : m + 65536], p[m : m + 65536]
                near = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
                x, y = x[near], y[near]
                degree += np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
                links.append((x, y))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = order[local_roots(len(ids), [(place[x], place[y]) for x, y in links])[place]]
        found = np.flatnonzero(degree)
        return pa.table({"a": ids[found], "n": degree[found], "b": ids[root[found]]})

    found = scratch.save(dealt.groupBy("label", "dims", "i", "j").applyInArrow(compare, "a long, n long, b long"))
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    group = components(found.select("a", "b"), scratch).withColumnRenamed("node", "id")
    out = rows.select("id").join(degree, "id", "left").join(group, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def blocks_of(n: int) -> int:
    """Blocks that a label of n vectors is dealt to."""
    return ceil(n / BLOCK)
