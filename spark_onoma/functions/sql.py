"""The name functions for SQL: ``register(spark)`` makes them callable as ``onoma_...`` in queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spark_onoma.functions import distance as d
from spark_onoma.functions import names as nm
from spark_onoma.functions import phonetic as ph
from spark_onoma.functions import scoring as sc
from spark_onoma.operators.match import resolved

#: (function, result type) by name; each takes strings.
SCALARS: dict[str, tuple[Callable, str]] = {
    "damerau": (d.damerau, "int"), "damerau_similarity": (d.damerau_similarity, "double"), "levenshtein_similarity": (d.levenshtein_similarity, "double"),
    "jaro": (d.jaro, "double"), "jaro_winkler": (d.jaro_winkler, "double"), "symmetric_jaro_winkler": (d.symmetric_jaro_winkler, "double"),
    "is_single_transposition": (d.is_single_transposition, "boolean"), "lcs_length": (d.lcs_length, "int"), "is_subsequence": (d.is_subsequence, "boolean"),
    "consonant_skeleton": (d.consonant_skeleton, "string"), "strict_skeleton": (d.strict_skeleton, "string"), "skeleton_similarity": (d.skeleton_similarity, "double"),
    "abbreviation_shape": (lambda a, b: d.abbreviation(a, b)[0], "string"), "abbreviation_strength": (lambda a, b: d.abbreviation(a, b)[1], "double"),
    "soundex": (ph.soundex, "string"), "refined_soundex": (ph.refined_soundex, "string"), "nysiis": (ph.nysiis, "string"),
    "metaphone_primary": (lambda x: ph.double_metaphone(x)[0], "string"), "metaphone_secondary": (lambda x: ph.double_metaphone(x)[1], "string"),
    "metaphone_full": (lambda x: ph.double_metaphone_full(x)[0], "string"), "phonetic_similarity": (ph.phonetic_similarity, "double"), "is_phonetic_match": (ph.is_phonetic_match, "boolean"), "phonetic_key": (ph.phonetic_key, "string"),
    "fold_accents": (nm.fold_accents, "string"), "differs_only_by_accents": (nm.differs_only_by_accents, "boolean"), "detect_script": (nm.detect_script, "string"), "strip_invisible": (nm.strip_invisible, "string"),
    "strip_combining_marks": (nm.strip_combining_marks, "string"), "collapse_whitespace": (nm.collapse_whitespace, "string"), "nfkd": (nm.to_nfkd, "string"), "nfc": (nm.to_nfc, "string"), "transliterate": (lambda x: nm.transliterate(x)[0], "string"),
    "is_latin_script": (nm.is_latin_script, "boolean"), "is_transliterable": (nm.is_transliterable, "boolean"), "canonical_generational": (nm.canonical_generational, "string"),
    "token_rarity": (sc.token_rarity, "double"), "orthographic_key": (sc.orthographic_key, "string"), "orthographic_variant": (sc.orthographic_variant, "double"), "abbreviation_evidence": (sc.abbreviation_evidence, "double"),
    "is_gendered_pair": (sc.is_gendered_pair, "boolean"), "is_plural_surname_pair": (sc.is_plural_surname_pair, "boolean"), "typo_channel": (sc.typo_channel, "double"),
}


def _score(options: sc.MatchOptions):
    def score(a, b) -> int:
        return max(1, min(100, int(1 + 99 * sc.best_evaluation(a, b, resolved(options))[0] + 0.5)))

    return score


def _arrow(f: Callable, kind: str, nulls: bool):
    """An Arrow UDF over one or two columns; a null gives null unless ``nulls`` are the function's own business."""
    one = lambda *v: f(*v) if nulls or None not in v else None
    if f.__code__.co_argcount - len(f.__defaults__ or ()) == 1:
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([one(x) for x in a], dtype=object)
    else:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)
    return F.pandas_udf(run, kind)


def register(spark: SparkSession, prefix: str = "onoma_", options: sc.MatchOptions = sc.MatchOptions()) -> list[str]:
    """Register the scalar functions, ``normalize`` and ``score(a, b)``; returns their names."""
    made = {name: _arrow(getattr(f, "__wrapped__", f), kind, False) for name, (f, kind) in SCALARS.items()}
    made["normalize"] = _arrow(lambda x: nm.normalize(x, options.normalize).normalized, "string", True)
    made["score"] = _arrow(_score(options), "int", True)
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    return [prefix + name for name in made]
