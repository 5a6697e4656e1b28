"""From similarities to scores, decisions and probabilities; gates, floors and ceilings over feature columns. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_onoma.functions.scoring import COMPONENTS, FEATURES, WEIGHTS

# Platt calibration of the shipped heuristic, and its prior.
SLOPE, INTERCEPT, MIDPOINT = 17.727131, -12.778914, 0.720868
PRIOR = (12.0, -8.4)


def _steps(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(last)


def to_score(s: Column) -> Column:
    """1 to 100, half up; 1 for what is no finite number."""
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1), F.least(F.lit(100), F.floor(1 + 99 * s + 0.5)))).otherwise(1).cast("int")


def from_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 1) / 99))


def confidence_of(score: Column) -> Column:
    return _steps(score, [(85, "very-high"), (70, "high"), (50, "medium"), (30, "low")], "very-low")


def band_of(score: Column) -> Column:
    return _steps(score, [(95, "extremely-strong"), (85, "strong"), (70, "likely"), (50, "possible"), (30, "weak")], "very-weak")


def probability_of(s: Column, slope: float = SLOPE, intercept: float = INTERCEPT) -> Column:
    return F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), 1 / (1 + F.exp(-(slope * s + intercept)))))


def scaled(multiplier, sensitivity: float) -> Column:
    return F.greatest(F.lit(0.05), 1 - (1 - multiplier) * sensitivity)


def gate_multipliers(sensitivity: float = 1.0) -> dict[str, Column]:
    """Multiplier of each gate over feature columns; null where it does not apply."""
    c = F.col
    like = c("distinctNamePenalty") > 0

    def when(test: Column, m) -> Column:
        return F.when(test, scaled(F.lit(m) if isinstance(m, float) else m, sensitivity))

    def weak(known: str, bad: str, value: str, floor: float) -> Column:
        return when((c(known) > 0) & (c(bad) == 0) & ~like & (c(value) >= 0.5) & (c(value) < 0.78), floor + (1 - floor) * (c(value) - 0.5) / 0.28)

    return {
        "family-name-conflict": when((c("familyNameConflict") > 0) & ~like, 0.55),
        "given-name-conflict": when((c("givenNameConflict") > 0) & ~like, 0.7),
        "look-alike-distinct-names": when(like, 0.6),
        "truncation-risk": when(c("truncationRisk") > 0, 0.85),
        "middle-name-conflict": when(c("middleNameConflict") > 0, 0.6),
        "weak-family-evidence": weak("lastNameKnown", "familyNameConflict", "lastNameSimilarity", 0.6),
        "weak-given-evidence": weak("firstNameKnown", "givenNameConflict", "firstNameSimilarity", 0.72),
        "suffix-conflict": when(c("suffixConflict") > 0, 0.72),
        "unresolved-script-difference": when((c("crossScript") > 0) & (c("transliterationSimilarity") == 0), 0.8),
        "token-order-differs": F.when(c("reordered") > 0, 0.97),
        "middle-name-omitted": F.when((c("middleNameOmitted") > 0) & (c("middleNameConflict") == 0), 0.97),
    }


def collect_conflicts(sensitivity: float = 1.0) -> Column:
    """array<struct<code, multiplier>> of the gates that apply."""
    rows = [F.when(m.isNotNull(), F.struct(F.lit(code).alias("code"), m.alias("multiplier"))) for code, m in gate_multipliers(sensitivity).items()]
    return F.array_compact(F.array(*rows))


def interaction_floor() -> Column:
    first, last, t = F.col("firstNameSimilarity"), F.col("lastNameSimilarity"), F.col("tokenSimilarity")
    return F.when((first >= 0.99) & (last >= 0.99), 0.9 + 0.08 * t).when((first >= 0.85) & (last >= 0.99), 0.84 + 0.08 * t).when((first >= 0.99) & (last >= 0.85), 0.82 + 0.08 * t).when((first >= 0.8) & (last >= 0.8), 0.7 + 0.1 * t).otherwise(0.0)


def evidence_ceiling() -> Column:
    c = F.col
    return F.least(
        F.when((c("singleTokenName") > 0) & (c("normalizedExact") == 0), 0.85).otherwise(1.0),
        F.when((c("minTokenCount") <= 1) & (c("rarityWeightedAgreement") < 0.5), 0.7).otherwise(1.0),
        F.when((c("shortestTokenLength") <= 1) & (c("minTokenCount") <= 2), 0.88).otherwise(1.0),
    )


def weighted_evidence(weights: dict[str, float] = WEIGHTS) -> Column:
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k, feature in COMPONENTS.items():
        if weights[k] > 0:
            counts = F.when(F.col(feature) > 0, 1.0).otherwise(0.0) if k in ("abbreviation", "alias") else F.lit(1.0)
            top, bottom = top + weights[k] * counts * F.col(feature), bottom + weights[k] * counts
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _apart(e: Column) -> Column:
    """An expression evaluated by itself. A compiled projection over the JVM's limit of 8000 bytes would run unoptimised."""
    return F.transform(F.array(F.lit(0)), lambda _: e)[0]


HARD_GATES = ("family-name-conflict", "given-name-conflict", "look-alike-distinct-names", "middle-name-conflict", "suffix-conflict")


def score_features(features: DataFrame, weights: dict[str, float] = WEIGHTS, sensitivity: float = 1.0) -> DataFrame:
    """Adds ``similarity``, ``score`` and ``gates`` to the 38 feature columns, by column arithmetic alone.

    Multipliers and evidence are parts of a projection of their own, so what several later expressions use is computed
    once. Columns of the three added names are replaced.
    """
    c, gates = F.col, gate_multipliers(sensitivity)
    own = [f"`{x}`" for x in features.columns if x not in ("similarity", "score", "gates")]
    exact = F.when((c("suffixConflict") == 0) & ((c("normalizedExact") > 0) | (c("compactExact") > 0)), F.least(F.when(c("normalizedExact") > 0, 1.0).otherwise(0.99), F.when(c("affixMismatch") > 0, 0.985).otherwise(1.0)))
    part = {code: c("__parts")[f"g{k}"] for k, code in enumerate(gates)}
    parts = F.struct(*[m.alias(f"g{k}") for k, m in enumerate(gates.values())], weighted_evidence(weights).alias("evidence"), interaction_floor().alias("floor"), evidence_ceiling().alias("ceiling"), exact.alias("exact"))
    out = features.select(*own, _apart(parts).alias("__parts"))
    hard = F.coalesce(*(part[g] for g in HARD_GATES)).isNotNull()
    value = F.greatest(c("__parts.evidence"), F.when(hard, 0.0).otherwise(c("__parts.floor")))
    for m in part.values():
        value = value * F.coalesce(m, F.lit(1.0))
    similarity = F.coalesce(c("__parts.exact"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("__parts.ceiling"), value)))
    names = F.array_compact(F.array(*[F.when(m.isNotNull(), code) for code, m in part.items()]))
    applied = F.when(c("__parts.exact").isNull(), names).otherwise(F.array().cast("array<string>"))
    return out.select(*own, _apart(similarity).alias("similarity"), applied.alias("gates")).select(*own, "similarity", to_score(c("similarity")).alias("score"), "gates")


def features_to_array() -> Column:
    """Features in key order; the three counts scaled to at most 1."""
    scale = {"tokenCountDifference": 3, "minTokenCount": 4, "shortestTokenLength": 8}
    return F.array(*[F.least(F.lit(1.0), F.col(k) / scale[k]) if k in scale else F.col(k).cast("double") for k in FEATURES])


def predict_probability(coefficients: list[float], intercept: float, features: str = "x") -> Column:
    """Logistic model over an array column."""
    if not coefficients:
        raise ValueError("the model is not trained")
    z = F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, coefficients)), lambda x, w: x * w), F.lit(float(intercept)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))
