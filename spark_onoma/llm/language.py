"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_onoma.llm.textops import U64, chunks, list_array, map_whole

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled documents per language that the model is fitted on at most.
PER_LANGUAGE = 600
# Fixed hyperparameters of the follow-the-regularised-leader steps.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of each letter or mark, 32 for all else; letters have bit 31 set."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            out[c] = (ord(low) if len(low) == 1 else c) | (1 << 31 if kind == "L" else 0)
    return out


def gram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """(row, n-gram buckets, counts) of each whole text; None for a text without a letter."""
    for first, last, data, offsets in chunks(column):
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=at[1:])
        bounds = at[offsets]
        mapped = _letters()[code]
        letter = np.zeros(len(code) + 1, np.int64)
        np.cumsum(mapped >> 31, out=letter[1:])
        mapped = mapped & 0x7FFFFFFF
        keep = np.ones(len(mapped), dtype=bool)
        if len(mapped):
            keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
        place = np.zeros(len(code) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        short = mapped[keep].astype(U64)
        grams = []
        for n in ORDERS:
            size = max(0, len(short) - n + 1)
            key = np.zeros(size, U64)
            for j in range(n):
                key = key * U64(0x100000001B3) + short[j : j + size] + U64(1)
            key *= U64(0x9E3779B97F4A7C15)
            grams.append((key >> U64(64 - 14)).astype(np.int32))
        for row in range(last - first):
            if letter[bounds[row + 1]] == letter[bounds[row]]:
                yield first + row, None, None
                continue
            a, b = int(place[bounds[row]]), int(place[bounds[row + 1]])
            count = np.bincount(np.concatenate([g[a : b - n + 1] for n, g in zip(ORDERS, grams, strict=True) if b - a >= n]), minlength=BUCKETS)
            found = np.flatnonzero(count)
            yield first + row, found, count[found]


class Model:
    """Weights (bucket x language), biases, inverse document frequencies, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf = languages, idf
        k = len(languages)
        self.weight, self.bias, self.temperature = np.zeros((BUCKETS, k), np.float32), np.zeros(k), 1.0

    def features(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[found]
        return x / max(1e-12, np.sqrt((x * x).sum()))

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weight[found] + self.bias

    def predict(self, found: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        z = self.logits(found, self.features(found, count)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL-proximal with an elastic net on four fifths of the rows, temperature on the rest."""
    model = Model(sorted({r[0] for r in rows}), idf)
    k = len(model.languages)
    index = {x: i for i, x in enumerate(model.languages)}
    if k < 2:
        return model
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    order = np.random.default_rng(5).permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 50 else order

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in fit:
            lang, found, count = rows[r]
            at, x = np.append(found, BUCKETS), np.append(model.features(found, count), 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[index[lang]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange(BUCKETS + 1))
    model.weight, model.bias = every[:-1].astype(np.float32), every[-1]
    scores = np.array([model.logits(f, model.features(f, c)) for _, f, c in (rows[r] for r in held)])
    truth = np.array([index[rows[r][0]] for r in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(axis=1))).mean())

    grid = np.geomspace(0.05, 5, 60)
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def fit_languages(docs: DataFrame, train_rows=None, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled rows (``train_rows``: a filter on doc_id, text and lang).

    Document frequencies cover every labelled row; weights are fitted on at most ``per_language`` documents of each
    language, those with the lowest hash of their id. A fifth of these sets the temperature; with fewer than 50 rows in
    all it is set on the training rows, so the score is then too sure. Rows with a null id tell frequencies only.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    known = known if train_rows is None else known.where(train_rows)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, found, _ in gram_counts(batch.column(0)):
                if found is not None:
                    seen[found] += 1
                    seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in known.select("text").mapInArrow(frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    # A language's hash range is sized to hold about four times the sample, so ranking reads no more than that.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("spot")).join(F.broadcast(sizes), "lang").where(F.col("spot") * F.col("n") <= float(4 * per_language << 30))
    pick = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id"))).where(F.col("k") <= per_language).select("doc_id").distinct()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = batch.column(1).to_pylist(), [(r, f, c) for r, f, c in gram_counts(batch.column(0)) if f is not None]
            size = np.array([len(f) for _, f, _ in rows], np.int64)
            flat = lambda k: np.concatenate([r[k] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r, _, _ in rows], pa.string()), list_array(flat(1), size, pa.int32()), list_array(flat(2), size, pa.int32())], names=["lang", "found", "n"])

    table = known.join(F.broadcast(pick), "doc_id", "left_semi").select("text", "lang").mapInArrow(grams, "lang string, found array<int>, n array<int>").toArrow()
    rows = [(lang, np.asarray(f.values), np.asarray(n.values)) for lang, f, n in zip(table["lang"].to_pylist(), table["found"], table["n"], strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), int(r[1].sum()), int(r[2].sum())))
    return train(rows, idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` (calibrated probability) added, predicted from whole texts.

    Null text or text without a letter: ``und`` with score 0. All input columns pass through; columns of those two
    names, in any case, are replaced. An empty table gives no row. A model of one language gives it to every text with
    probability 1; rows that share an id are predicted each by their own text.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    own = [F.col(f"`{c}`") for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for row, found, count in gram_counts(batch.column(at)):
                if found is not None and model.languages:
                    names[row], scores[row] = model.predict(found, count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*own, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return map_whole(docs.select(*own), run, schema)
