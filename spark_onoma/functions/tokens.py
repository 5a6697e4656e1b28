"""Words of a name as columns: provenance of each word, multiset statistics, initials. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spark_onoma.functions.lexicon import PARTICLES


def is_particle_col(word: Column) -> Column:
    return word.isin(sorted(PARTICLES))


def to_tokens_col(words: Column) -> Column:
    """array<struct<text, index, is_initial, is_particle, length>> of an array of words."""
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), i.alias("index"), (F.length(w) == 1).alias("is_initial"), is_particle_col(w).alias("is_particle"), F.length(w).alias("length")))


def token_set_stats_col(a: Column, b: Column) -> Column:
    """struct<intersection, union_size, only_in_a, only_in_b, jaccard, identical> of two arrays as multisets.

    Words come in order of their first place in ``a``, then in ``b``. No word at all: a Jaccard of 0, not identical.
    """
    count = lambda x, k: F.size(F.filter(x, lambda w: w == k))
    keys = F.transform(F.array_distinct(F.concat(a, b)), lambda k: F.struct(k.alias("k"), count(a, k).alias("m"), count(b, k).alias("n")))
    times = lambda n: F.flatten(F.transform(keys, lambda s: F.array_repeat(s["k"], n(s))))
    both = times(lambda s: F.least(s["m"], s["n"]))
    left, right = times(lambda s: F.greatest(s["m"] - s["n"], F.lit(0))), times(lambda s: F.greatest(s["n"] - s["m"], F.lit(0)))
    union = F.size(both) + F.size(left) + F.size(right)
    return F.struct(
        both.alias("intersection"), union.alias("union_size"), left.alias("only_in_a"), right.alias("only_in_b"),
        F.when(union == 0, 0.0).otherwise(F.size(both) / union).alias("jaccard"),
        ((F.size(left) == 0) & (F.size(right) == 0) & (F.size(a) > 0)).alias("identical"),
    )


def initials_col(words: Column, include_particles: bool = False) -> Column:
    """First letters of the words, particles left out unless asked for."""
    own = words if include_particles else F.filter(words, lambda w: ~is_particle_col(w))
    return F.filter(F.transform(own, lambda w: F.substring(w, 1, 1)), lambda c: c != "")


def initial_compatibility_col(a: Column, b: Column) -> Column:
    """0.88 for two equal initials, 0.82 for an initial and a word that starts with it, else 0; null for two whole words."""
    one = (F.length(a) == 1) | (F.length(b) == 1)
    alike = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.length(a) > 0)
    return F.when(one, F.when(alike, F.when(F.length(a) == F.length(b), 0.88).otherwise(0.82)).otherwise(0.0))
