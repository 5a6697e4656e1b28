"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.decontaminate import bare_words
from spark_onoma.llm.textops import U64, chunks, list_array, mix

#: Labelled documents that voters are found and weighted on at most: those with the lowest hash of their id.
MAX_LABELLED = 20_000
#: Voters at most; the strongest stay.
MAX_VOTERS = 2_000
#: Code points of word beginnings that are candidate voters beside whole words.
STEMS = (4, 5, 6)
MIN_POSITIVE, MIN_PRECISION = 3, 0.6
# Pattern voters: hashes that stand for them.
SHOUTING, EXCLAIMING = U64(1), U64(2)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature) for whole texts: words, word beginnings, two text patterns."""
    for first, last, data, offsets in chunks(column):
        n, words = last - first, bare_words(data, offsets)
        rows, keys = [words.doc], [words.hash]
        heads = np.flatnonzero((words.data & 0xC0) != 0x80)
        begin, size = np.searchsorted(heads, words.start), np.searchsorted(heads, words.end)
        size -= begin
        for k in STEMS:
            long = np.flatnonzero(size > k)
            rows.append(words.doc[long])
            keys.append(mix(words.span_hash(words.start[long], heads[begin[long] + k]) + U64(k)))
        length = np.maximum(1, np.diff(offsets))
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        upper, letters = count((data >= 65) & (data <= 90)), count(((data | 32) >= 97) & ((data | 32) <= 122))
        rows.append(np.flatnonzero((upper > 0.5 * letters) & (letters >= 20)))
        keys.append(np.full(len(rows[-1]), SHOUTING))
        rows.append(np.flatnonzero(count(data == 33) > 0.02 * length))
        keys.append(np.full(len(rows[-1]), EXCLAIMING))
        yield first, n, np.concatenate(rows), np.concatenate(keys)


def _fired(row: np.ndarray, key: np.ndarray, voters: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, voter) pairs; ``voters`` sorted, ``order`` their numbers."""
    if not len(voters):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(voters, key), len(voters) - 1)
    hit = voters[at] == key
    pair = np.unique(row[hit].astype(np.int64) * len(voters) + at[hit])
    return pair // len(voters), order[pair % len(voters)]


class ToxicModel:
    def __init__(self, voters: np.ndarray, weight: np.ndarray, bias: float) -> None:
        order = np.argsort(voters)
        self.voters, self.order, self.weight, self.bias = voters[order], order, weight, bias

    def scores(self, first: int, n: int, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        r, v = _fired(row, key, self.voters, self.order)
        z = self.bias + np.bincount(r, weights=self.weight[v], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def correlation_shares(row: np.ndarray, voter: np.ndarray, count: int, n_rows: int) -> np.ndarray:
    """Weight of each voter: 1 over the summed overlap (Jaccard of the fired rows) with all voters, itself included."""
    fires = np.bincount(voter, minlength=count)
    together = np.zeros((count, count), np.float32)
    order = np.argsort(row, kind="stable")
    row, voter = row[order], voter[order]
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            together[np.ix_(voter[a:b], voter[a:b])] += 1
    union = fires[:, None] + fires[None, :] - together
    overlap = np.where(union > 0, together / np.maximum(union, 1), 0)
    return 1 / np.maximum(1, overlap.sum(axis=1))


def label_model(row: np.ndarray, voter: np.ndarray, count: int, label: np.ndarray, steps: int = 5) -> np.ndarray:
    """Posterior of toxicity of each row from the voters' votes.

    Each voter fires with one probability on toxic and another on other rows, or abstains, which tells nothing; one
    more voter fires where all abstain. Correlated voters share their evidence. The probabilities start from the
    labels and are re-estimated from the posteriors, in which a row's label is one more voter.
    """
    n = len(label)
    silent = np.flatnonzero(np.bincount(row, minlength=n) == 0)
    row, voter = np.concatenate([row, silent]), np.concatenate([voter, np.full(len(silent), count)])
    share = correlation_shares(row, voter, count + 1, n)
    post = np.clip(label.astype(float), 0.02, 0.98)
    for _ in range(steps):
        mass, rest = post.sum(), (1 - post).sum()
        hit = (np.bincount(voter, weights=post[row], minlength=count + 1) + 0.5) / (mass + 1)
        miss = (np.bincount(voter, weights=1 - post[row], minlength=count + 1) + 0.5) / (rest + 1)
        z = np.log((mass + 1) / (rest + 1)) + np.bincount(row, weights=(share * np.log(hit / miss))[voter], minlength=n) + np.where(label > 0, 3.0, -3.0)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post


def linear(row: np.ndarray, voter: np.ndarray, count: int, target: np.ndarray, label: np.ndarray, steps: int = 1000, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of the posteriors on the fired voters, none of which may lower a score; then Platt scaling on the labels."""
    n, weight, bias = len(target), np.zeros(count), 0.0
    scale, scale_bias = np.full(count, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=weight[voter], minlength=n), -30, 30)))
        gap = p - target
        g = np.bincount(voter, weights=gap[row], minlength=count) + ridge * n * 0.01 * weight
        scale += g * g
        scale_bias += gap.sum() ** 2
        weight = np.maximum(0, weight - 0.5 * g / np.sqrt(scale))
        bias -= 0.5 * gap.sum() / np.sqrt(scale_bias)
    z = bias + np.bincount(row, weights=weight[voter], minlength=n)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((p - label) * z).sum() + 0.01 * (a - 1), (p - label).sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return weight * max(a, 0.1), bias * max(a, 0.1) + b


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows=None, max_labelled: int = MAX_LABELLED) -> ToxicModel:
    """Fit on at most ``max_labelled`` labelled documents (``train_rows``: a filter on the labels' doc_id).

    Words, word beginnings and patterns that are precise for the label become voters; a generative label model weighs
    them by accuracy and correlation; a linear classifier is trained on its posterior labels. Rows of ``labels`` with
    a null id or label are left out; of repeated ids the highest label counts. ``MAX_VOTERS`` bounds the voters that are
    fitted, found on those labelled rows alone; scoring looks at every word of every text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known if train_rows is None else known.where(train_rows)
    pick = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id").select("text", "toxic")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1)).astype(np.int64)
            for first, n, row, key in features(batch.column(0)):
                order = np.lexsort((row, key))
                row, key = row[order], key[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                row, key = row[new], key[new]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(key)))
                positive = np.add.reduceat(toxic[first : first + n][row], start) if len(key) else size
                yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(positive.astype(np.int64)), pa.array(size.astype(np.int64))], names=["feature", "pos", "n"])

    found = rows.mapInArrow(tally, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    strong = found.where((F.col("pos") >= MIN_POSITIVE) & (F.col("pos") >= MIN_PRECISION * F.col("n"))).orderBy(F.desc(F.col("pos") * F.col("pos") / F.col("n")), "feature").limit(MAX_VOTERS)
    voters = np.array([r["feature"] for r in strong.collect()], np.int64).view(U64)
    order = np.argsort(voters)
    sorted_voters = voters[order]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, key in features(batch.column(0)):
                r, v = _fired(row, key, sorted_voters, order)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, n), list_array(v.astype(np.int32), np.bincount(r, minlength=n), pa.int32())], names=["toxic", "votes"])

    table = rows.mapInArrow(votes, "toxic int, votes array<int>").toArrow()
    label = table["toxic"].to_numpy().astype(float)
    if not len(label) or not len(voters):
        rate = (label.sum() + 0.5) / (len(label) + 1)
        return ToxicModel(voters[:0], np.zeros(0), float(np.log(rate / (1 - rate))))
    lists = table["votes"].combine_chunks()
    voter = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy())
    weight, bias = linear(row, voter, len(voters), label_model(row, voter, len(voters), label), label)
    return ToxicModel(voters, weight, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null and empty texts get the score of no voter firing.

    Null ids are kept, repeated rows scored each, other columns ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, key in features(batch.column(1)):
                score = shared.value.scores(first, n, row, key)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
