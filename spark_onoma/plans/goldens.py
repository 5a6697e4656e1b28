"""Queries over published cases: the operators' results on fixed inputs beside the values that they are known to have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_onoma.functions import distance as d
from spark_onoma.functions import names as nm
from spark_onoma.functions import phonetic as ph
from spark_onoma.functions import scoring as sc
from spark_onoma.functions import sql as sql_functions
from spark_onoma.functions import tokens as tk
from spark_onoma.operators import evaluate, generate, match

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def golden(name: str, inputs: str, outputs: str, rows: list[tuple], work=None, frame=None) -> None:
    """Register a query of ``rows`` (inputs, then known outputs): ``work`` on each row's inputs or ``frame`` on all of them."""
    fields = [f.split(" ") for f in (inputs + ", " + outputs).split(", ")]
    count = len(inputs.split(", "))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    _SQL[name] = "SELECT " + ", ".join(f'CAST("{c}" AS {_KINDS[k]}) AS "{c}"' for c, k in fields) + f" FROM (VALUES {values}) AS t(" + ", ".join(f'"{c}"' for c, _ in fields) + ")"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = spark.createDataFrame([r[:count] for r in rows], inputs)
        done = frame(given) if frame else match._once(given, [c for c, _ in fields[:count]], f"struct<{outputs.replace(' ', ':').replace(',:', ',')}>", lambda *v: tuple(work(*v)))
        return done.select(*[F.col(c).cast(k) for c, k in fields])

    _QUERIES[name] = run


def facts(name: str, cases: dict[str, Callable[[], bool]]) -> None:
    """Register a query of statements, all of which hold."""
    golden(name, "statement string", "holds boolean", [(k, True) for k in cases], lambda k: (bool(cases[k]()),))


def _joined(words) -> str:
    return " ".join(words)


def _plain(**options) -> sc.Resolved:
    return match.resolved(sc.MatchOptions(**options))


def _score(a, b, **options) -> int:
    return int(1 + 99 * sc.best_evaluation(a, b, _plain(**options))[0] + 0.5)


# Published scores of pairs.
SCORES = [
    ("John McDonald", "John MacDonald", 99), ("Patrick O'Brien", "Patrick OBrien", 99), ("Smith, John A.", "John Alan Smith", 98), ("Steve Rogers", "Steven Rogers", 94), ('John "Jack" Smith', "John Smith", 93), ("Peggy Wilson", "Margaret Wilson", 92), ("Polly Adams", "Mary Adams", 92), ("Nancy Foster", "Ann Foster", 92), ("Nate Baker", "Kate Baker", 57), ("Sally Brooks", "Sally Brook", 34),
    ("सत्येंद्र सागर सिंह", "Satyendra Sagar Singh", 100), ("Rajesh Kumar S/O Suresh", "Rajesh Kumar", 100), ("Satyendra Sagar Singh", "Singh, Satyendra Sagar", 100), ("Satyendra Sagar Singh", "S S Singh", 90), ("Smt Sunita Devi", "Sunita Devi", 99), ("Ram Kumar Yadav", "Ramkumar Yadav", 99), ("Geetha Krishnan", "Geeta Krishnan", 98), ("Padmanabhan Iyer", "Padmanaban Iyer", 98), ("Lakshmi Narayanan", "Laxmi Narayanan", 97), ("Rajeev Menon", "Rajiv Menon", 97),
    ("Anoop Nambiar", "Anup Nambiar", 97), ("M S Dhoni", "Mahendra Singh Dhoni", 90), ("V V S Laxman", "Vangipurappu Venkata Sai Laxman", 89), ("Priya Menon", "Riya Menon", 64), ("Deepak Verma", "Deepika Verma", 60), ("Amit Shah", "Amit Sah", 48), ("Satyendra Sagar Singh", "Satyendra Kumar Singh", 47), ("Rajesh Kumar S/O Suresh", "Suresh Kumar", 36),
    ("John Smith", "John Smith", 100), ("José García", "Jose Garcia", 100), ("Mary-Jane Smith", "Mary Jane Smith", 100), ("Smith, John", "John Smith", 100), ("राहुल शर्मा", "Rahul Sharma", 100), ("Dr. John Smith", "John Smith", 99), ("Abdul Rahman", "Abdulrahman", 99), ("John Smith", "Jon Smith", 99), ("Katherine Jones", "Kathryn Jones", 99), ("Jan van der Berg", "Jan Vanderberg", 99), ("محمد علي", "Mohammad Ali", 98), ("Jonh Smith", "John Smith", 96),
    ("John Smith", "Smith John", 96), ("Mohd Rahman", "Mohammad Rahman", 95), ("John Michael Smith", "John Smith", 93), ("Mohammad Abdul Rahman", "Mohd A Rahman", 93), ("Bob Smith", "Robert Smith", 92), ("A K Sharma", "Ajay Kumar Sharma", 90), ("John Smith Jr", "John Smith Sr", 72), ("John Lee", "Jon Li", 63), ("John Smith", "Peter Smith", 39), ("Michael Johnson", "Michelle Johnson", 38), ("Wei Zhang", "Wei Chang", 33), ("Raj Kumar", "Rajesh Kumar", 32), ("John Smith", "John Jones", 26), ("John Smith", "Peter Jones", 7),
]
# Pairs that must not match.
APART = [("Michael Johnson", "Michelle Johnson"), ("Raj Kumar", "Rajesh Kumar"), ("John Smith Jr", "John Smith Sr"), ("John A Smith", "John B Smith"), ("Daniel Craig", "Danielle Craig"), ("Erik Larsson", "Erika Larsson"), ("Ana Silva", "Anastasia Silva"), ("Zhang Wei", "Chang Wei"), ("Smith", "John Smith"), ("R Patel", "S Patel"), ("Maria de la Cruz", "Maria de la Torre"), ("", "John Smith")]


def _confidence(score: int) -> str:
    return "very-high" if score >= 85 else "high" if score >= 70 else "medium" if score >= 50 else "low" if score >= 30 else "very-low"


golden("published_scores", "a string, b string", "score int, matched boolean, confidence string", [(a, b, s, s >= 75, _confidence(s)) for a, b, s in SCORES], frame=match.match_names)
golden("published_scores_only", "a string, b string", "score int", SCORES, frame=match.similarity_score)
golden("published_scores_slow_path", "a string, b string", "score int", SCORES, frame=lambda f: match.similarity_score(f, options=sc.MatchOptions(fast_path=False)))
golden("published_non_matches", "a string, b string", "matched boolean", [(a, b, False) for a, b in APART], frame=match.match_names)
golden("published_non_matches_strict", "a string, b string", "matched boolean", [(a, b, False) for a, b in APART], frame=lambda f: match.match_names(f, options=sc.MatchOptions(mode="strict")))
golden("detailed_result", "a string, b string", "left string, right string, first_close boolean, last double, evidenced boolean, model string, inside boolean, aligned boolean, band string",
       [("Mohammad Abdul Rahman", "Mohd A Rahman", "mohammad abdul rahman", "mohd a rahman", True, 1.0, True, "heuristic", True, True, "strong"), ("John Smith", "Jon Smith", "john smith", "jon smith", True, 1.0, True, "heuristic", True, True, "extremely-strong"), ("John Smith", "Peter Jones", "john smith", "peter jones", False, 0.0, True, "heuristic", True, True, "very-weak")],
       frame=lambda f: match.match_names(f, options=sc.MatchOptions(detailed=True)).select("a", "b", F.col("parts.a.normalized").alias("left"), F.col("parts.b.normalized").alias("right"), (F.col("features.firstNameSimilarity") > 0.8).alias("first_close"), F.floor("features.lastNameSimilarity").alias("last"), ((F.size("evidence") > 0) & F.forall("evidence", lambda e: e["code"] != "")).alias("evidenced"), "model", F.col("probability").between(1e-9, 1 - 1e-9).alias("inside"), (F.size("alignment") > 0).alias("aligned"), "band"))
golden("reasons", "a string, b string", "suffix boolean, nickname boolean, abbreviation boolean, negative boolean",
       [("John Smith Jr", "John Smith Sr", True, False, False, True), ("Bob Smith", "Robert Smith", False, True, False, False), ("Mohd Rahman", "Mohammad Rahman", False, False, True, False)],
       frame=lambda f: match.match_names(f, options=sc.MatchOptions(detailed=True)).select("a", "b", *[F.rlike(F.lower(F.concat_ws("; ", "reasons")), F.lit(p)).alias(k) for k, p in (("suffix", "suffix"), ("nickname", "nickname|variant"), ("abbreviation", "abbreviation"))], F.exists("evidence", lambda e: e["polarity"] == "negative").alias("negative")))
golden("ranked_candidates", "query string, candidate string", "rank int", [("John Smith", "Peter Jones", 3), ("John Smith", "Jon Smith", 2), ("John Smith", "John Smith", 1)],
       frame=lambda f: match.NameMatcher(sc.MatchOptions(mode="strict")).rank(f.select("query").distinct(), f.select("candidate").distinct()))

facts("match_options", {
    "a threshold at the score matches": lambda: _plain(threshold=float(_score("John Michael Smith", "John Smith"))).options.resolved_threshold <= _score("John Michael Smith", "John Smith"),
    "a threshold above the score does not": lambda: _plain(threshold=_score("John Michael Smith", "John Smith") + 1.0).options.resolved_threshold > _score("John Michael Smith", "John Smith"),
    "fuzzy mode matches a dropped middle name": lambda: _score("John Michael Smith", "John Smith", mode="fuzzy") >= 62,
    "strict mode scores no higher than balanced": lambda: _score("John Michael Smith", "John Smith", mode="strict") <= _score("John Michael Smith", "John Smith"),
    "an alias raises a score": lambda: _score("Zed Smith", "Zebulon Smith", aliases=(("zed", ("zebulon",)),)) > _score("Zed Smith", "Zebulon Smith"),
    "a distinct pair lowers one": lambda: _score("Ana Nunez", "Ana Nunes", distinct_names=(("nunez", "nunes"),)) < 75 <= _score("Ana Nunez", "Ana Nunes"),
    "the look-alike table can be turned off": lambda: _score("Michael Johnson", "Michelle Johnson", disable_default_distinct_names=True) > _score("Michael Johnson", "Michelle Johnson"),
    "the alias table can be turned off": lambda: _score("Bob Smith", "Robert Smith", disable_default_aliases=True) < _score("Bob Smith", "Robert Smith"),
    "titles can be kept": lambda: _score("Dr. John Smith", "John Smith", normalize=nm.NormalizeOptions(strip_titles=False)) < _score("Dr. John Smith", "John Smith"),
    "weights can be changed": lambda: _score("John Smith", "John Jones", weights=(("lastName", 0.0),)) > _score("John Smith", "John Jones"),
    "options differ in their keys": lambda: len({sc.options_key(sc.MatchOptions(mode=m)) for m in sc.MODES}) == 3 and sc.options_key(sc.MatchOptions()) == sc.options_key(sc.MatchOptions()),
    "a threshold over the range is cut": lambda: sc.MatchOptions(threshold=500).resolved_threshold == 100,
    "a threshold under the range is cut": lambda: sc.MatchOptions(threshold=-5).resolved_threshold == 1,
    "a threshold that is no number is the default": lambda: sc.MatchOptions(threshold=float("nan")).resolved_threshold == 75,
    "thresholds fall from strict to fuzzy": lambda: [t for t, _ in sc.MODES.values()] == [88, 75, 62],
    "sensitivities fall from strict to fuzzy": lambda: sc.MODES["strict"][1] > 1 > sc.MODES["fuzzy"][1],
    "a score stays after caches are cleared": lambda: (_score("Mohd Rahman", "Mohammad Rahman"), match.clear_caches(), _score("Mohd Rahman", "Mohammad Rahman"))[::2] == (95, 95),
    "long and odd inputs score from 1 to 100": lambda: all(1 <= _score(a, b) <= 100 for a, b in (("", ""), ("   ", "John Smith"), ("123", "456"), ("!!!", "???"), (None, "John Smith"), (None, None), ("a" * 1000, "a" * 1000), ("John Smith", "John " * 50))),
})

# Normalisation

golden("normalised_names", "name string", "normalized string, compact string, titles string, suffixes string, script string, inverted boolean", [
    ("  José García-Márquez Jr. ", "jose garcia marquez", "josegarciamarquez", "", "jr", "latin", False), ("Mary-Jane Smith", "mary jane smith", "maryjanesmith", "", "", "latin", False), ("O'Connor Sean", "o connor sean", "oconnorsean", "", "", "latin", False), ("JOHN SMITH", "john smith", "johnsmith", "", "", "latin", False), ("extra    spaces", "extra spaces", "extraspaces", "", "", "latin", False),
    ("Smith, John Michael", "john michael smith", "johnmichaelsmith", "", "", "latin", True), ("Smith, Jr", "smith", "smith", "", "jr", "latin", False), ("Dr. John Smith PhD", "john smith", "johnsmith", "dr", "phd", "latin", False), ("Md Rahman", "md rahman", "mdrahman", "", "", "latin", False), ("Gen Chen", "gen chen", "genchen", "", "", "latin", False),
    ("John Smith (deceased)", "john smith", "johnsmith", "", "", "latin", False), ("John Smith #2", "john smith", "johnsmith", "", "", "latin", False), ("", "", "", "", "", "latin", False), ("   ", "", "", "", "", "latin", False), ("123", "", "", "", "", "latin", False), (None, "", "", "", "", "latin", False),
], lambda x: (lambda n: (n.normalized, n.compact, _joined(n.titles), _joined(n.suffixes), n.script, n.comma_inverted))(nm.normalize(x)))
golden("readings_of_names", "name string", "readings int, last string", [("Sri Ram Iyer", 2, "sri ram iyer"), ("John Smith", 1, "john smith"), ("Dr Ram Iyer", 1, "ram iyer")], lambda x: (len(nm.normalize_variants(x)), nm.normalize_variants(x)[-1].normalized))
golden("folded_names", "name string", "folded string", [("José García-Márquez", "Jose Garcia-Marquez"), ("François Lefèvre", "Francois Lefevre"), ("Jørgen", "Jorgen"), ("Łukasz", "Lukasz"), ("Straße", "Strasse"), ("Þór", "Thor"), ("Ægir", "Aegir"), ("Đorđe", "Dorde")], lambda x: (nm.fold_accents(x),))
golden("accent_differences", "a string, b string", "differs boolean", [("José", "Jose", True), ("Jose", "Jose", False), ("Jose", "Josef", False)], lambda a, b: (nm.differs_only_by_accents(a, b),))
golden("unicode_forms", "text string", "nfkd int, nfc int, bare string, visible string, spaced string", [("é", 2, 1, "é", "é", "é"), ("é", 2, 1, "e", "é", "é"), ("ﬁ", 2, 1, "ﬁ", "ﬁ", "ﬁ"), ("a​b­c", 5, 5, "a​b­c", "abc", "a​b­c"), (" a \t b\n", 7, 7, " a \t b\n", " a \t b\n", "a b")],
       lambda x: (len(nm.to_nfkd(x)), len(nm.to_nfc(x)), nm.strip_combining_marks(x), nm.strip_invisible(x), nm.collapse_whitespace(x)))
golden("scripts_of_names", "text string", "script string, latin boolean, romanised boolean", [("John Smith", "latin", True, False), ("राहुल शर्मा", "devanagari", False, True), ("محمد علي", "arabic", False, True), ("Владимир Петров", "cyrillic", False, True), ("Γεώργιος", "greek", False, True), ("שרה כהן", "hebrew", False, True), ("王伟", "han", False, True), ("J. R. R. Tolkien, 2nd", "latin", True, False)],
       lambda x: (nm.detect_script(x), nm.is_latin_script(nm.detect_script(x)), nm.is_transliterable(nm.detect_script(x))))
golden("scripts_by_frequency", "text string", "scripts string", [("ab Иван", "cyrillic latin"), ("abc", "latin"), ("", ""), ("王 Wang", "latin han")], lambda x: (_joined(nm.detect_scripts(x)),))
golden("romanised_names", "text string", "latin string, changed boolean", [("राहुल", "rahul", True), ("शर्मा", "sharma", True), ("कुमार", "kumar", True), ("प्रिया", "priya", True), ("محمد", "muhammad", True), ("علي", "ali", True), ("Петров", "petrov", True), ("Παπαδόπουλος", "papadopoulos", True), ("John Smith", "John Smith", False)], lambda x: (nm.transliterate(x)[0], nm.transliterate(x)[1] != "none"))
golden("generational_suffixes", "token string", "canonical string", [(t, c) for c, ts in {"jr": ("jr", "jnr", "junior"), "sr": ("sr", "snr", "senior"), "ii": ("ii",), "iii": ("iii",), "iv": ("iv",), "v": ("v",), "vi": ("vi",), "vii": ("vii",), "viii": ("viii",), "ix": ("ix",), None: ("x", "phd")}.items() for t in ts], lambda t: (nm.canonical_generational(t),))
golden("extra_affixes", "name string", "normalized string, titles string, suffixes string", [("Chief John Smith FRS", "john smith", "chief", "frs"), ("Dr John Smith FRS", "john smith", "dr", "frs")], lambda x: (lambda n: (n.normalized, _joined(n.titles), _joined(n.suffixes)))(nm.normalize(x, nm.NormalizeOptions(extra_titles=("Chief",), extra_suffixes=("FRS",)))))

# Words and parts


def _tokens(frame: DataFrame) -> DataFrame:
    t = frame.withColumn("w", F.split("words", " ")).withColumn("t", F.explode(tk.to_tokens_col(F.col("w"))))
    return t.groupBy("words").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(":", "t.index", "t.text", "t.length", "t.is_initial", "t.is_particle")))).alias("tokens"), F.first(F.concat_ws(" ", tk.initials_col(F.col("w")))).alias("initials"))


golden("tokens_of_names", "words string", "tokens string, initials string", [("john michael smith", "0:john:4:false:false 1:michael:7:false:false 2:smith:5:false:false", "j m s"), ("jan van berg", "0:jan:3:false:false 1:van:3:false:true 2:berg:4:false:false", "j b"), ("a k sharma", "0:a:1:true:false 1:k:1:true:false 2:sharma:6:false:false", "a k s")], frame=_tokens)


def _stats(frame: DataFrame) -> DataFrame:
    s = frame.withColumn("s", tk.token_set_stats_col(F.split("a", " "), F.split("b", " ")))
    return s.select("a", "b", *[F.concat_ws(" ", f"s.{k}").alias(k) for k in ("intersection", "only_in_a", "only_in_b")], "s.union_size", F.round("s.jaccard", 9).alias("jaccard"), "s.identical")


golden("token_multisets", "a string, b string", "intersection string, only_in_a string, only_in_b string, union_size int, jaccard double, identical boolean", [("john smith", "smith john", "john smith", "", "", 2, 1.0, True), ("john michael smith", "john smith", "john smith", "michael", "", 3, 0.666666667, False), ("a a b", "a c", "a", "a b", "c", 4, 0.25, False)], frame=_stats)
golden("initial_pairs", "a string, b string", "compatible double", [("j", "j", 0.88), ("j", "john", 0.82), ("john", "j", 0.82), ("j", "k", 0.0), ("j", "kate", 0.0), ("john", "jon", None)], frame=lambda f: f.withColumn("compatible", tk.initial_compatibility_col(F.col("a"), F.col("b"))))
golden("particles", "words string", "units string, head string", [("van der berg", "van der berg", "berg"), ("ana de la cruz", "ana|de la cruz", "anacruz"), ("john van", "john|van", "john"), ("abd kamau", "abd|kamau", "kamau")], lambda x: ("|".join(nm.group_particles(x.split(" "))), nm.family_head(x.split(" "))))
golden("parsed_names", "name string, locale string, family_first boolean", "given string, middle string, family string, suffix string, ambiguous boolean, key string", [
    ("John Michael Smith", "auto", False, "john", "michael", "smith", "", False, "smith"), ("John Smith", "auto", False, "john", "", "smith", "", False, "smith"), ("Smith, John", "auto", False, "john", "", "smith", "", False, "smith"), ("John Smith Jr", "auto", False, "john", "", "smith", "jr", False, "smith"), ("Jan van der Berg", "auto", False, "jan", "", "van der berg", "", False, "berg"), ("Abd Kamau", "auto", False, "abd", "", "kamau", "", False, "kamau"),
    ("Madonna", "auto", False, "madonna", "", "", "", True, None), ("Jose Garcia Marquez", "es", False, "jose", "", "garcia|marquez", "", False, "garciamarquez"), ("Jose Garcia Marquez", "en", False, "jose", "garcia", "marquez", "", False, "marquez"), ("Chen Wei", "auto", True, "wei", "", "chen", "", False, "chen"), ("", "auto", False, "", "", "", "", True, None),
], lambda x, locale, first: (lambda p: ("|".join(p.given), "|".join(p.middle), "|".join(p.family), "|".join(p.suffix), p.ambiguous, nm.family_key(p)))(nm.parse_name(x, nm.ParseOptions(locale, first))))
golden("reconciled_words", "a string, b string", "left string, right string, merged boolean", [("abdul rahman", "abdulrahman", "abdulrahman", "abdulrahman", True), ("john smith", "jon smith", "john smith", "jon smith", False), ("john michael smith", "john smith", "john michael smith", "john smith", False)], lambda a, b: (lambda r: (_joined(r[0]), _joined(r[1]), r[2]))(nm.reconcile(a.split(" "), b.split(" "))))

# Distances, sequences, sounds: through the functions that are registered for SQL


def _sql(*calls: str):
    """Columns by SQL calls of the registered functions."""

    def run(frame: DataFrame) -> DataFrame:
        sql_functions.register(frame.sparkSession)
        return frame.selectExpr("*", *calls)

    return run


golden("edit_distances", "a string, b string", "levenshtein int, damerau int, transposed boolean, similarity double", [("john", "jon", 1, 1, False, 0.75), ("kitten", "sitting", 3, 3, False, 0.571428571), ("", "abc", 3, 3, False, 0.0), ("abc", "abc", 0, 0, False, 1.0), ("jonh", "john", 2, 1, True, 0.5), ("ca", "abc", 3, 2, False, 0.0), ("john", "jean", 2, 2, False, 0.5), ("", "", 0, 0, False, 1.0)],
       frame=_sql("levenshtein(a, b) AS levenshtein", "onoma_damerau(a, b) AS damerau", "onoma_is_single_transposition(a, b) AS transposed", "round(onoma_levenshtein_similarity(a, b), 9) AS similarity"))
golden("jaro_values", "a string, b string", "jaro double, winkler double, symmetric double", [("MARTHA", "MARHTA", 0.944444, 0.961111, 0.961111), ("DIXON", "DICKSONX", 0.766667, 0.813333, 0.813333), ("smith", "smith", 1.0, 1.0, 1.0), ("abc", "xyz", 0.0, 0.0, 0.0)],
       frame=_sql("round(onoma_jaro(a, b), 6) AS jaro", "round(onoma_jaro_winkler(a, b), 6) AS winkler", "round(onoma_symmetric_jaro_winkler(a, b), 6) AS symmetric"))
golden("subsequences", "a string, b string", "lcs int, inside boolean", [("ace", "abcde", 3, True), ("abc", "xyz", 0, False), ("", "abc", 0, True), ("mohd", "mohammad", 4, True), ("wm", "william", 2, True), ("xyz", "william", 0, False)], frame=_sql("onoma_lcs_length(a, b) AS lcs", "onoma_is_subsequence(a, b) AS inside"))
golden("skeletons", "word string", "loose string, strict string", [("mohammad", "mhmd", "mhmd"), ("muhammed", "mhmd", "mhmd"), ("aeiou", "a", ""), ("yates", "yts", "yts"), ("bryan", "brn", "bryn")], frame=_sql("onoma_consonant_skeleton(word) AS loose", "onoma_strict_skeleton(word) AS strict"))
golden("orders", "indices string", "rising int, similarity double, tau double, reversed boolean", [("0 1 2 3", 4, 1.0, 0.0, False), ("3 2 1 0", 1, 0.25, 1.0, True), ("0 2 1", 2, 0.666666667, 0.333333333, False), ("5", 1, 1.0, 0.0, False), ("1 0", 1, 0.5, 1.0, True)],
       lambda x: (lambda v: (d.lis_length(v), round(d.order_similarity(v), 9), round(d.kendall_tau_distance(v), 9), d.is_complete_reversal(v)))([int(i) for i in x.split(" ")]))
golden("sound_codes", "word string", "soundex string, primary string, secondary string, full string", [("Robert", "R163", "RPRT", "RPRT", "RPRT"), ("Ashcraft", "A261", "AXKR", "AXKR", "AXKRFT"), ("Tymczak", "T522", "TMSK", "TMXK", "TMSK"), ("Smith", "S530", "SM0", "XMT", "SM0"), ("Schmidt", "S530", "XMT", "SMT", "XMT"), ("Knight", "K523", "NT", "NT", "NT"), ("Wright", "W623", "RT", "RT", "RT"), ("Thompson", "T512", "TMPS", "TMPS", "TMPSN"), ("Thomson", "T525", "TMSN", "TMSN", "TMSN"), ("Lee", "L000", "L", "L", "L"), ("", "", "", "", "")],
       frame=_sql("onoma_soundex(word) AS soundex", "onoma_metaphone_primary(word) AS primary", "onoma_metaphone_secondary(word) AS secondary", "onoma_metaphone_full(word) AS full"))
golden("sound_matches", "a string, b string", "matches boolean, nysiis boolean, refined boolean", [("smith", "schmidt", True, False, False), ("macdonald", "mcdonald", True, True, False), ("knight", "night", True, True, False), ("phillips", "fillips", True, True, False), ("braz", "broz", True, True, True)],
       frame=_sql("onoma_is_phonetic_match(a, b) AS matches", "onoma_nysiis(a) = onoma_nysiis(b) AS nysiis", "onoma_refined_soundex(a) = onoma_refined_soundex(b) AS refined"))
golden("sounds_alike", "a string, b string", "matches boolean", [(a, b, True) for a, b in (("catherine", "katherine"), ("sofia", "sophia"), ("steven", "stephen"), ("meyer", "maier"), ("carl", "karl"), ("jon", "john"), ("reilly", "reily"))] + [(a, b, False) for a, b in (("john", "peter"), ("smith", "jones"), ("garcia", "martinez"), ("sharma", "verma"))], frame=_sql("onoma_is_phonetic_match(a, b) AS matches"))
facts("sounds", {
    "equal words sound equal": lambda: ph.phonetic_similarity("smith", "smith") == 1,
    "smyth sounds much like smith": lambda: ph.phonetic_similarity("smith", "smyth") > 0.9,
    "peter does not sound like john": lambda: ph.phonetic_similarity("john", "peter") < 0.5,
    "no letters, no sound": lambda: ph.phonetic_similarity("", "smith") == ph.phonetic_similarity("123", "smith") == 0,
    "pneumonia starts with n": lambda: ph.double_metaphone("Pneumonia")[0].startswith("N"),
    "psalm starts with s": lambda: ph.double_metaphone("Psalm")[0].startswith("S"),
    "short codes are cut from full ones": lambda: len(ph.double_metaphone_full("Rodriguez")[0]) > 4 and ph.double_metaphone("Rodriguez")[0] == ph.double_metaphone_full("Rodriguez")[0][:4],
    "odd words have codes": lambda: all(isinstance(ph.double_metaphone_full(x), tuple) for x in ("", "x", "zzzz", "aeiou", "ghghgh", "o'connor", "x" * 500)),
    "equal sounds share a blocking key": lambda: ph.phonetic_key("catherine") == ph.phonetic_key("katherine"),
})

# Word pairs, pairings, features

golden("abbreviation_shapes", "a string, b string", "shape string", [("mohd", "mohammad", "contraction"), ("wm", "william", "contraction"), ("robt", "robert", "contraction"), ("raj", "rajesh", "truncation"), ("ana", "anastasia", "truncation"), ("smith", "asmith", "none")], frame=_sql("onoma_abbreviation_shape(a, b) AS shape"))
golden("initial_sequences", "a string, b string", "least double, most double", [("a k sharma", "ajay kumar sharma", 1.0, 1.0), ("john michael smith", "john smith", 0.75, 1.0), ("r patel", "s patel", 0.0, 0.6)], lambda a, b: next(x for x in ((1.0, 1.0), (0.75, 1.0), (0.0, 0.6)) if x[0] <= sc.compare_initials(a.split(" "), b.split(" ")) <= x[1]))
golden("assignments", "matrix string", "columns string", [("0.8 0.2|0.3 0.9", "0 1"), ("0.9 0.85|0.88 0.0", "1 0"), ("0.1 0.9 0.2", "1"), ("0.1|0.9|0.2", "-1 0 -1"), ("", "")], lambda x: (_joined(map(str, d.assign_max([[float(v) for v in row.split(" ")] for row in x.split("|")] if x else []))),))
golden("pairings_of_words", "a string, b string", "coverage double, core double, word_order double", [("john smith", "smith john", 1.0, 1.0, 0.5), ("john michael smith", "john smith", 0.666666667, 1.0, 1.0), ("john", "", 0.0, 0.0, 0.5), ("a b c", "c b a", 1.0, 1.0, 0.333333333)], lambda a, b: (lambda x: (round(x.coverage, 9), round(x.core, 9), round(x.order, 9)))(sc.align(a.split(), b.split(), _plain().tokens)))
golden("alias_strengths", "a string, b string", "strength double, kind string", [("bob", "robert", 0.9, "nickname"), ("peggy", "margaret", 0.9, "nickname"), ("katherine", "kathryn", 0.97, "variant"), ("geetha", "geeta", 0.96, "transliteration"), ("john", "juan", 0.55, "translation"), ("john", "peter", 0.0, None)], lambda a, b: (_plain().alias_strength(a, b), _plain().shared_kind(a, b)))
golden("word_channels", "a string, b string", "score double, kind string", [("john", "john", 1.0, "exact"), ("j", "john", 0.82, "initial"), ("j", "j", 1.0, "exact"), ("j", "kate", 0.0, "unmatched"), ("", "john", 0.0, "unmatched"), ("bob", "robert", 0.9, "alias"), ("mohd", "mohammad", 0.95, "abbreviation"), ("jonh", "john", 0.9, "typo"), ("michael", "michelle", 0.3, "phonetic"), ("brook", "brooks", 0.3, "typo")], lambda a, b: (round(_plain().tokens(a, b)[0], 9), _plain().tokens(a, b)[1]))
facts("word_pairs", {
    "a feminine ending makes a gendered pair": lambda: sc.is_gendered_pair("daniel", "danielle") and sc.is_gendered_pair("erika", "erik") and not sc.is_gendered_pair("john", "joan"),
    "a trailing s makes another family": lambda: sc.is_plural_surname_pair("brook", "brooks") and not sc.is_plural_surname_pair("john", "johns"),
    "spelling folds of one sound": lambda: [sc.orthographic_key(x) for x in ("lakshmi", "rajeev", "anoop", "padmanabhan")] == [sc.orthographic_key(x) for x in ("laxmi", "rajiv", "anup", "padmanaban")],
    "a folded spelling is a variant": lambda: sc.orthographic_variant("geetha", "geeta") == 0.93 and sc.orthographic_variant("shah", "sah") == 0,
    "a known contraction is strong evidence": lambda: sc.abbreviation_evidence("mohd", "mohammad") == 0.95 > sc.abbreviation_evidence("raj", "rajesh"),
    "a whole short name is weak evidence": lambda: sc.abbreviation_evidence("ana", "anastasia") < sc.abbreviation_evidence("anas", "anastasia"),
    "a transposition is a light typo": lambda: sc.typo_channel("jonh", "john") == 0.9 > sc.typo_channel("john", "jean"),
    "two known names are damped": lambda: _plain().tokens("mark", "mary")[0] < sc.typo_channel("mark", "mary"),
    "common names weigh less": lambda: sc.token_rarity("john") == 0.35 < sc.token_rarity("patrick") == 0.6 < sc.token_rarity("vangipurappu") == 1 and sc.token_rarity("j") == 0.2,
    "words in either order have one score": lambda: all(_plain().tokens(a, b) == _plain().tokens(b, a) for a, b in (("jon", "john"), ("mohd", "mohammad"), ("smyth", "smith"))),
    "agreement on rare words is worth more": lambda: sc.rarity_agreement([("john", "john", 1.0), ("zyx", "abc", 0.4)], []) < sc.rarity_agreement([("vangipurappu", "vangipurappu", 1.0), ("j", "k", 0.4)], []),
    "skeletons compare consonants": lambda: d.skeleton_similarity("mohammad", "muhammed") == 1 and d.skeleton_similarity("aei", "oou") == 0,
})
_SHOWN = "exact normalizedExact compactExact tokenSetExact tokenSimilarity coreTokenSimilarity tokenJaccard tokenOrderSimilarity reordered firstNameSimilarity lastNameSimilarity tokenCountDifference minTokenCount middleNameOmitted suffixConflict affixMismatch singleTokenName crossScript".split()
golden("features_of_pairs", "a string, b string", ", ".join(f"{k} double" for k in _SHOWN), [
    ("John Smith", "John Smith", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("John Michael Smith", "John Smith", 0.0, 0.0, 0.0, 0.0, 0.666666667, 1.0, 0.666666667, 1.0, 0.0, 1.0, 1.0, 1.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0),
    ("John Smith", "Smith John", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("John Smith Jr", "John Smith Sr", 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 2.0, 0.0, 1.0, 1.0, 0.0, 0.0),
    ("राहुल शर्मा", "Rahul Sharma", 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0),
], frame=lambda f: match.extract_features(f).select("a", "b", *[F.round(k, 9).alias(k) for k in _SHOWN]))


# Generated pairs


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the engine on generated pairs against the gates it must pass."""
    scored = match.match_names(generate.labelled_pairs(spark)).select("a", "b", "expected", "category", "score")
    m, auc = evaluate.metrics(scored, 75), evaluate.area_under_roc(scored)
    tests = {"precision": m["precision"] >= 0.98, "recall": m["recall"] >= 0.98, "f1": m["f1"] >= 0.985, "fpr": m["fpr"] <= 0.02, "auc": F.col("auc") >= 0.995}
    return m.crossJoin(auc).select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), t.alias("holds")) for k, t in tests.items()])).alias("g")).select("g.*")


_QUERIES["accuracy_gates"] = _gates
_SQL["accuracy_gates"] = "SELECT * FROM (VALUES ('precision', true), ('recall', true), ('f1', true), ('fpr', true), ('auc', true)) AS t(gate, holds)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
