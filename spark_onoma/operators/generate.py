"""Labelled name pairs for evaluation: positives by mutation, negatives by construction, all from a seed by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Our own corpus: given and family names by tradition.
CORPUS = {
    "english": ("James Mary Robert Patricia William Linda Thomas Susan Edward Helen George Alice Walter Emily Henry Grace", "Smith Johnson Baker Turner Harrison Whitfield Crawford Bennett Holloway Pearson Langley Mercer Thornton Ashworth Fletcher Kingsley"),
    "indian": ("Rahul Priya Sanjay Lakshmi Vikram Sunita Arjun Deepa Krishnan Meera Suresh Kavita Harish Anjali Mohan Padma", "Sharma Patel Iyer Reddy Banerjee Chatterjee Deshpande Kulkarni Nambiar Venkataraman Bhattacharya Mukherjee Subramanian Agarwal Choudhary Rangaswamy"),
    "iberian": ("Carlos Sofia Miguel Lucia Alejandro Carmen Fernando Isabel Rodrigo Beatriz Joaquin Elena Santiago Pilar Esteban Marta", "Garcia Rodriguez Fernandez Gonzalez Dominguez Castellanos Villanueva Santamaria Echeverria Montenegro Valenzuela Zamora Figueroa Arredondo Caballero Quintana"),
    "german": ("Hans Greta Friedrich Ingrid Klaus Ursula Heinrich Brigitte Wolfgang Helga Dieter Sabine Manfred Renate Gerhard Monika", "Schneider Hoffmann Zimmermann Krause Lehmann Baumgartner Steinberg Vogelsang Rosenthal Lindemann Hartmann Brandt Falkenberg Obermeier Waldmann Kaufmann"),
}
TITLES, SUFFIXES = "Dr Mr Mrs Prof".split(), "Jr PhD Esq".split()
POSITIVES = "case typo transposition initials missing-middle token-order comma-order prefix suffix whitespace".split()
NEGATIVES = "neg-same-family neg-same-given neg-middle-initial neg-suffix neg-unrelated neg-single-token".split()


def _draw(seed: int, salt: str) -> Column:
    """A number from 0 to 2**30 - 1 that hangs on the seed, the row and what it is drawn for."""
    return F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(salt)), F.lit(1 << 30))


def _pick(words, seed: int, salt: str, other: Column | None = None) -> Column:
    """A word of a list; with ``other`` one that differs from the word of that number."""
    table = F.array(*map(F.lit, words)) if isinstance(words, list) else words
    at = F.pmod(_draw(seed, salt), F.size(table)) if other is None else F.pmod(other + 1 + F.pmod(_draw(seed, salt), F.size(table) - 1), F.size(table))
    return F.element_at(table, at.cast("int") + 1)


def swap_letters(text: Column, at: Column) -> Column:
    """The text with the letters at ``at`` and the next place exchanged."""
    return F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1, F.lit(1)), F.substr(text, at, F.lit(1)), F.substr(text, at + 2))


def drop_letter(text: Column, at: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1))


def labelled_pairs(spark: SparkSession, per_category: int = 40, seed: int = 20240101) -> DataFrame:
    """(a, b, expected, category): ``per_category`` draws of each category, pairs that came out equal left out.

    The same seed gives the same pairs on any number of machines: every draw is a hash of seed, row and purpose.
    """
    kinds = POSITIVES + NEGATIVES
    rows = spark.range(per_category * len(kinds)).withColumn("category", F.element_at(F.array(*map(F.lit, kinds)), F.pmod(F.col("id"), F.lit(len(kinds))).cast("int") + 1))
    tables = [F.struct(*(F.array(*map(F.lit, names.split())).alias(k) for k, names in zip(("given", "family"), pair, strict=True))) for pair in CORPUS.values()]
    rows = rows.withColumn("t", F.element_at(F.array(*tables), F.pmod(_draw(seed, "tradition"), F.lit(len(tables))).cast("int") + 1))
    at = {k: F.pmod(_draw(seed, k), F.size(F.col(f"t.{k}"))) for k in ("given", "family")}
    g, f = (F.element_at(F.col(f"t.{k}"), at[k].cast("int") + 1) for k in ("given", "family"))
    rows = rows.select("id", "category", g.alias("g"), f.alias("f"), _pick(F.col("t.given"), seed, "middle", at["given"]).alias("m"), _pick(F.col("t.given"), seed, "given2", at["given"]).alias("g2"), _pick(F.col("t.family"), seed, "family2", at["family"]).alias("f2"))
    c = F.col
    place = F.pmod(_draw(seed, "place"), F.length("f") - 3).cast("int") + 2
    letter = F.chr(F.lit(65) + F.pmod(_draw(seed, "letter"), F.lit(26)))
    letter2 = F.chr(F.lit(65) + F.pmod(_draw(seed, "letter") + 1 + F.pmod(_draw(seed, "letter2"), F.lit(25)), F.lit(26)))
    name = lambda *parts: F.concat_ws(" ", *parts)
    plain, full = name(c("g"), c("f")), name(c("g"), c("m"), c("f"))
    pairs = {
        "case": (plain, F.when(F.pmod(_draw(seed, "case"), F.lit(2)) == 0, F.upper(plain)).otherwise(F.lower(plain))), "typo": (plain, name(c("g"), drop_letter(c("f"), place))), "transposition": (plain, name(c("g"), swap_letters(c("f"), place))),
        "initials": (full, name(F.substring("g", 1, 1), F.substring("m", 1, 1), c("f"))), "missing-middle": (full, plain), "token-order": (plain, name(c("f"), c("g"))), "comma-order": (plain, F.concat(c("f"), F.lit(", "), c("g"))),
        "prefix": (plain, name(F.concat(_pick(TITLES, seed, "title"), F.lit(".")), plain)), "suffix": (plain, name(plain, _pick(SUFFIXES, seed, "suffix"))), "whitespace": (plain, F.concat(F.lit("  "), c("g"), F.lit("   "), c("f"), F.lit(" "))),
        "neg-same-family": (plain, name(c("g2"), c("f"))), "neg-same-given": (plain, name(c("g"), c("f2"))), "neg-middle-initial": (name(c("g"), letter, c("f")), name(c("g"), letter2, c("f"))), "neg-suffix": (name(plain, F.lit("Jr")), name(plain, F.lit("Sr"))),
        "neg-unrelated": (plain, name(c("g2"), c("f2"))), "neg-single-token": (c("f"), plain),
    }

    def side(k: int) -> Column:
        out = None
        for category, pair in pairs.items():
            out = F.when(c("category") == category, pair[k]) if out is None else out.when(c("category") == category, pair[k])
        return out

    made = rows.select(side(0).alias("a"), side(1).alias("b"), F.when(c("category").startswith("neg-"), "different").otherwise("match").alias("expected"), "category")
    return made.where("a <> b").distinct()
