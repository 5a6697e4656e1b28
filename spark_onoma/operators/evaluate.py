"""Evaluation of scored pairs, datasets, and training of calibration, weights and a logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_onoma.functions.scoring import MODES, WEIGHTS
from spark_onoma.operators.decide import PRIOR, score_features


def _share(x: Column, y: Column) -> Column:
    return F.when(y == 0, 0.0).otherwise(x / y)


def metrics(scored: DataFrame, threshold: int, *by: str) -> DataFrame:
    """Confusion counts and rates overall and by category (one rollup; null keys are totals) of ``expected, score``."""
    hit, match = F.col("score") >= threshold, F.col("expected") == "match"
    counts = [F.count_if(hit & match).alias("tp"), F.count_if(hit & ~match).alias("fp"), F.count_if(~hit & ~match).alias("tn"), F.count_if(~hit & match).alias("fn"), F.count(F.lit(1)).alias("total")]
    out = (scored.rollup(*by) if by else scored.groupBy()).agg(*counts)
    c = F.col
    out = out.withColumn("precision", _share(c("tp"), c("tp") + c("fp"))).withColumn("recall", _share(c("tp"), c("tp") + c("fn")))
    return out.withColumn("f1", _share(2 * c("precision") * c("recall"), c("precision") + c("recall"))).withColumn("accuracy", _share(c("tp") + c("tn"), c("total"))).withColumn("fpr", _share(c("fp"), c("fp") + c("tn"))).withColumn("fnr", _share(c("fn"), c("fn") + c("tp")))


def sweep_thresholds(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, f1) at 1 to 100: one count per score, then a running sum over 100 rows."""
    counts = scored.groupBy(F.col("score").cast("int").alias("threshold")).agg(F.count_if(F.col("expected") == "match").alias("m"), F.count_if(F.col("expected") != "match").alias("d"))
    line = scored.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("threshold")).join(counts, "threshold", "left").fillna(0, ["m", "d"])
    w = Window.orderBy(F.desc("threshold"))
    sums = line.select("threshold", F.sum("m").over(w).alias("tp"), F.sum("d").over(w).alias("fp"), F.sum("m").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("positives"))
    return sums.select("threshold", "tp", "fp", F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))).alias("f1"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The first threshold of the highest F1."""
    return sweep_thresholds(scored).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def area_under_roc(scored: DataFrame) -> DataFrame:
    """Rank-sum AUC with mean ranks for ties; 0.5 if a class is missing. The window runs over distinct scores."""
    counts = scored.groupBy("score").agg(F.count_if(F.col("expected") == "match").alias("m"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("m") * (before + (F.col("n") + 1) / 2))
    sums = ranked.agg(F.sum("ranks").alias("r"), F.sum("m").alias("p"), (F.sum("n") - F.sum("m")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return sums.select(F.when((p == 0) | (q == 0) | p.isNull(), 0.5).otherwise((F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def worst_cases(scored: DataFrame, threshold: int, limit: int | None = 20) -> DataFrame:
    """Wrong decisions: false positives from the highest score, then false negatives from the lowest; all without a limit."""
    hit, match = F.col("score") >= threshold, F.col("expected") == "match"
    wrong = scored.where(hit != match).withColumn("kind", F.when(hit, "fp").otherwise("fn"))
    found = wrong.orderBy(F.desc("kind"), F.when(hit, -F.col("score")).otherwise(F.col("score")), "a", "b")
    return found if limit is None else found.limit(limit)


def dedupe_pairs(pairs: DataFrame, order: str) -> DataFrame:
    """One row of each unordered pair: the first by ``order``."""
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(order)
    return pairs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def summarise(pairs: DataFrame) -> DataFrame:
    """Counts by category, one column per label."""
    return pairs.groupBy("category").pivot("expected", ["match", "different"]).count().fillna(0)


def validation_matrix(scored: DataFrame, modes: dict[str, int]) -> DataFrame:
    """Metrics by dataset and mode."""
    frame = scored.sparkSession.createDataFrame(list(modes.items()), "mode string, threshold int")
    hit, match = F.col("score") >= F.col("threshold"), F.col("expected") == "match"
    return scored.crossJoin(F.broadcast(frame)).groupBy("dataset", "mode").agg(F.count_if(hit & match).alias("tp"), F.count_if(hit & ~match).alias("fp"), F.count_if(~hit & match).alias("fn"), F.count_if(~hit & ~match).alias("tn"))


def fit_calibration(samples: DataFrame, iterations: int = 4000, rate: float = 0.5) -> tuple[float, float, int]:
    """(slope, intercept, rows): a fixed number of gradient steps from the prior, over counts of distinct samples.

    The counts come to the driver: one row per distinct (similarity, label), scores being integers from 1 to 100.
    """
    rows = samples.groupBy("similarity", "label").count().collect()
    x, y, n = (np.array([r[k] for r in rows], float) for k in range(3))
    slope, intercept = PRIOR
    for _ in range(iterations if len(rows) else 0):
        gap = n * (1 / (1 + np.exp(-(slope * x + intercept))) - y)
        slope, intercept = slope - rate * (gap * x).sum() / n.sum(), intercept - rate * gap.sum() / n.sum()
    return float(slope), float(intercept), int(n.sum()) if len(rows) else 0


def train_logistic(samples: DataFrame, iterations: int = 300, rate: float = 0.6, l2: float = 0.002, negative_weight: float = 1.4) -> tuple[list[float], float]:
    """(coefficients, intercept) by batch gradient descent over ``x array<double>, label``.

    Each step is one aggregation over the cached samples, so rows never leave the executors. An empty table gives no coefficient.
    """
    samples = samples.select("x", F.col("label").cast("double").alias("y"), F.when(F.col("label") > 0, 1.0).otherwise(negative_weight).alias("w")).cache()
    size, total = samples.agg(F.max(F.size("x")), F.sum("w")).first()
    if not size:
        samples.unpersist()
        return [], 0.0
    weights, bias = np.zeros(size), 0.0
    for _ in range(iterations):
        z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in weights]), lambda p, q: p * q), F.lit(float(bias)), lambda s, v: s + v)
        gap = F.col("w") * (1 / (1 + F.exp(-z)) - F.col("y"))
        row = samples.select(gap.alias("g"), "x").agg(F.sum("g").alias("b"), *[F.sum(F.col("g") * F.col("x")[k]).alias(f"g{k}") for k in range(size)]).first()
        grad = np.array([row[f"g{k}"] for k in range(size)])
        weights, bias = weights - rate * (grad / total + l2 * weights), bias - rate * row["b"] / total
    samples.unpersist()
    return [float(v) for v in weights], float(bias)


def tune_weights(features: DataFrame, modes: dict[str, tuple[int, float]] = MODES, factors=(0.5, 0.7, 0.85, 1.2, 1.5, 2.0), rounds: int = 1) -> dict[str, float]:
    """Coordinate ascent of the mean F1 of ``expected`` over all modes, ties by the AUC, over the heuristic's weights."""
    features = features.cache()
    best, at = dict(WEIGHTS), mode_quality(features, WEIGHTS, modes)
    for _ in range(rounds):
        for k in WEIGHTS:
            for factor in factors:
                trial = best | {k: best[k] * factor}
                if adopt(at, q := mode_quality(features, trial, modes)):
                    best, at = trial, q
    features.unpersist()
    return best


def build_report(scored: DataFrame, threshold: int, cases: int = 20) -> dict[str, DataFrame]:
    """The parts of a report by name: overall, by category, every threshold, the best one, the AUC and the worst cases."""
    by = metrics(scored, threshold, "category")
    return {"overall": by.where("category is null").drop("category"), "by_category": by.where("category is not null"), "thresholds": sweep_thresholds(scored), "best": best_threshold(scored), "auc": area_under_roc(scored), "worst": worst_cases(scored, threshold, cases)}


def mode_quality(features: DataFrame, weights: dict[str, float], modes: dict[str, tuple[int, float]]) -> tuple[float, float]:
    """(mean F1 over the modes at their thresholds and sensitivities, AUC at the plain sensitivity)."""
    f1 = [metrics(score_features(features, weights, sensitivity), threshold).first()["f1"] for threshold, sensitivity in modes.values()]
    return sum(f1) / len(f1), area_under_roc(score_features(features, weights)).first()["auc"]


def adopt(now: tuple[float, float], trial: tuple[float, float], margin: float = 1e-4) -> bool:
    """Is a trial's (F1, AUC) better by the margin in F1, or equal to it and better in AUC?"""
    return trial[0] > now[0] + margin or abs(trial[0] - now[0]) <= margin and trial[1] > now[1] + 1e-9


def bigram_dice(a: str, b: str) -> Column:
    """Dice of the sets of letter pairs."""
    def pairs(x: str) -> Column:
        return F.array_distinct(F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(F.col(x), i, F.lit(2)))).otherwise(F.array().cast("array<string>")))

    both = F.size(pairs(a)) + F.size(pairs(b))
    return F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(pairs(a), pairs(b))) / both)
