"""Queries over the driver's tables, one or more per operator, and SQL to compare them with."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_onoma.functions import distance as d
from spark_onoma.functions import lexicon as lex
from spark_onoma.functions import names as nm
from spark_onoma.functions import phonetic as ph
from spark_onoma.functions import scoring as sc
from spark_onoma.operators import decide, evaluate, match
from spark_onoma.streaming.match import score_stream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where("name is not null").distinct()


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unordered pairs of the distinct part names; their number is bounded by the two word lists of the table."""
    names = _part_names(spark, sf_dir)
    return names.select(F.col("name").alias("a")).join(names.select(F.col("name").alias("b")), F.col("a") < F.col("b"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents."""
    return _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("word")).where("word <> ''").distinct()


_PAIRS = "names AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL), pairs AS (SELECT x.name AS a, y.name AS b FROM names x JOIN names y ON x.name < y.name)"
_TOKENS = "tokens AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part), pairs AS (SELECT x.t AS a, y.t AS b FROM tokens x JOIN tokens y ON x.t < y.t)"
_WORDS = "words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) WHERE word <> '')"


def _token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _part_names(spark, sf_dir).select(F.explode(F.split("name", " ")).alias("t")).distinct()
    return t.select(F.col("t").alias("a")).join(t.select(F.col("t").alias("b")), F.col("a") < F.col("b"))


def _udf(f, kind: str) -> Callable[..., Column]:
    """An Arrow UDF of a kernel over columns."""
    return F.pandas_udf(lambda *columns: pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object), kind)


@F.pandas_udf(T.IntegerType())
def _damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([d.damerau(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([d.jaro(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([d.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([d.lcs_length(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def _fold(x: pd.Series) -> pd.Series:
    return x.map(nm.fold_accents)


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in ("primary", "secondary", "nysiis", "key")]))
def _codes(x: pd.Series) -> pd.DataFrame:
    codes = x.map(ph.double_metaphone_full)
    return pd.DataFrame({"primary": codes.str[0], "secondary": codes.str[1], "nysiis": x.map(ph.nysiis), "key": x.map(ph.phonetic_key)})


# Entry points


@query()
def similarity_score(spark, sf_dir):
    """Score of every pair of part names."""
    return match.similarity_score(_name_pairs(spark, sf_dir)).select("a", "b", "score")


@query()
def match_names_detailed(spark, sf_dir):
    out = match.match_names(_name_pairs(spark, sf_dir), options=sc.MatchOptions(detailed=True))
    return out.select("a", "b", "score", "matched", "confidence", "band", F.round("probability", 6).alias("probability"), F.concat_ws("; ", "reasons").alias("reasons"))


@query()
def extract_features(spark, sf_dir):
    return match.extract_features(_name_pairs(spark, sf_dir)).select("a", "b", *[F.round(k, 9).alias(k) for k in sc.FEATURES])


@query()
def rank_names_topk(spark, sf_dir):
    """The five best other part names of each part name."""
    n = _part_names(spark, sf_dir)
    return match.rank_names(n.select(F.col("name").alias("query")), n.select(F.col("name").alias("candidate")), 5).select("query", "candidate", "score", "matched", "rank")


@query("SELECT DISTINCT c_name AS a, c_name AS b, 100 AS score, true AS matched, 'very-high' AS confidence FROM customer WHERE c_name IS NOT NULL")
def match_names_fast_path(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").where("c_name is not null").select(F.col("c_name").alias("a"), F.col("c_name").alias("b")).distinct()
    return match.match_names(c).select("a", "b", "score", "matched", "confidence")


@query(f"WITH {_PAIRS} SELECT a, b, true AS kept FROM pairs")
def score_by_mode_monotone(spark, sf_dir):
    """A stricter mode never scores a pair higher: true for every pair."""
    p = _name_pairs(spark, sf_dir)
    loose = match.similarity_score(p, options=sc.MatchOptions(mode="fuzzy")).withColumnRenamed("score", "loose")
    strict = match.similarity_score(p, options=sc.MatchOptions(mode="strict")).withColumnRenamed("score", "strict")
    return loose.join(strict, ["a", "b"]).select("a", "b", (F.col("strict") <= F.col("loose")).alias("kept"))


# Normalisation


@query(r"SELECT DISTINCT c_name AS name, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]', ' ', 'g'), '\b[0-9]+\b', '', 'g'), ' +', ' ', 'g')) AS normalized FROM customer")
def normalize_customer_names(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct()
    return match.normalize_names(c, "name").select("name", F.col("readings")[0]["normalized"].alias("normalized"))


_ATOMIC = "word"
for _old, _new in lex.ATOMIC_LETTERS.items():
    _ATOMIC = f"replace({_ATOMIC}, '{_old}', '{_new}')"


@query(f"WITH {_WORDS} SELECT word, strip_accents({_ATOMIC}) AS folded FROM words")
def fold_accents(spark, sf_dir):
    return _words(spark, sf_dir).withColumn("folded", _fold("word"))


@query(f"WITH {_WORDS} SELECT word, lower(strip_accents({_ATOMIC})) AS folded, word <> strip_accents({_ATOMIC}) AS accented FROM words")
def fold_accents_native(spark, sf_dir):
    """Latin letters folded by built-in functions: canonical letters by translation, the rest by replacement."""
    one = {k: v for k, v in lex.ATOMIC_LETTERS.items() if len(v) == 1}
    wide = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c) not in lex.ATOMIC_LETTERS and len(nm.fold_accents(chr(c))) == 1 and nm.fold_accents(chr(c)) != chr(c)]
    table = one | {c: nm.fold_accents(c) for c in wide}
    folded = F.translate("word", "".join(table), "".join(table.values()))
    for k, v in lex.ATOMIC_LETTERS.items():
        if len(v) > 1:
            folded = F.replace(folded, F.lit(k), F.lit(v))
    return _words(spark, sf_dir).select("word", F.lower(folded).alias("folded"), (F.col("word") != folded).alias("accented"))


@query(f"WITH {_WORDS} SELECT word, len(regexp_replace(word, '[^A-Za-zªºÀ-ɏ]', '', 'g')) AS latin, CASE WHEN regexp_matches(word, '[A-Za-zªºÀ-ɏ]') OR NOT regexp_matches(word, '[^\\x00-¿ -⁯]') THEN 'latin' ELSE 'unknown' END AS script FROM words")
def detect_script(spark, sf_dir):
    script = _udf(nm.detect_script, "string")
    return _words(spark, sf_dir).select("word", F.length(F.regexp_replace("word", "[^A-Za-zªºÀ-ɏ]", "")).cast("long").alias("latin"), script("word").alias("script"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\x0b\f]+', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))


@query()
def transliterate_goldens(spark, sf_dir):
    rows = [(w, *nm.transliterate(w)) for w in [*lex.WORDS, "王伟", "Иванов", "Παπαδόπουλος", "דוד"]]
    return spark.createDataFrame(rows, "word string, latin string, source string")


@query("WITH t(name, titles, tokens, suffixes) AS (VALUES ('Dr. John Smith PhD', 'dr', 'john smith', 'phd'), ('Smith, John Michael', '', 'john michael smith', ''), ('Md Rahman', '', 'md rahman', ''), ('Rajesh Kumar S/O Suresh', '', 'rajesh kumar', ''), ('John Smith Jr', '', 'john smith', 'jr')) SELECT n.n_nationkey AS n_nationkey, t.* FROM nation n CROSS JOIN t")
def affixes_and_commas(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("Dr. John Smith PhD", "Smith, John Michael", "Md Rahman", "Rajesh Kumar S/O Suresh", "John Smith Jr")], "name string")
    r = match.normalize_names(_table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(names)), "name")
    first = F.col("readings")[0]
    return r.select("n_nationkey", "name", *[F.concat_ws(" ", first[k]).alias(k) for k in ("titles", "tokens", "suffixes")])


# Tokens and parsing


@query("SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] AS given, string_split(p_name, ' ')[2] AS family FROM part WHERE p_name IS NOT NULL")
def parse_names(spark, sf_dir):
    p = match.parse_names(_part_names(spark, sf_dir), "name")
    return p.select("name", F.concat_ws(" ", "parsed.given").alias("given"), F.concat_ws(" ", "parsed.family").alias("family"))


@query(f"WITH {_PAIRS}, t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pairs) SELECT a, b, len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))) AS jaccard, list_sort(x) = list_sort(y) AS identical FROM t")
def token_set_stats(spark, sf_dir):
    x, y = F.split("a", " "), F.split("b", " ")
    return _name_pairs(spark, sf_dir).select("a", "b", d.token_jaccard_col(x, y).alias("jaccard"), (F.array_sort(x) == F.array_sort(y)).alias("identical"))


@query("WITH t AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL), r AS (SELECT name, w, unnest(range(1, len(w) + 1)) AS i FROM t), k AS (SELECT name, w, i, unnest([2, 3]) AS n FROM r) SELECT name, array_to_string(w[i:i + n - 1], '') AS text, i - 1 AS first, i + n - 2 AS last FROM k WHERE i + n - 1 <= len(w)")
def concatenation_variants(spark, sf_dir):
    n = _part_names(spark, sf_dir).select("name", F.split("name", " ").alias("w"))
    runs = n.select("name", "w", F.posexplode("w").alias("i", "t")).select("name", "w", "i", F.explode(F.array(F.lit(2), F.lit(3))).alias("n")).where("i + n <= size(w)")
    return runs.select("name", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), "").alias("text"), F.col("i").cast("long").alias("first"), (F.col("i") + F.col("n") - 1).cast("long").alias("last"))


@query("SELECT DISTINCT p_name AS name, array_to_string(list_transform(string_split(p_name, ' '), lambda t: t[1:1]), '') AS initials FROM part WHERE p_name IS NOT NULL")
def initials(spark, sf_dir):
    return _part_names(spark, sf_dir).select("name", F.array_join(F.transform(F.split("name", " "), lambda t: F.substring(t, 1, 1)), "").alias("initials"))


# Distances


@query(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(len(a), len(b)), 9) AS similarity, least(levenshtein(a, b), 4) AS bounded FROM pairs")
def levenshtein(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(d.levenshtein_similarity_col("a", "b"), 9).alias("similarity"), d.levenshtein_col("a", "b", 3).cast("long").alias("bounded"))


@query(f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(a, b) AS distance, round(1 - damerau_levenshtein(a, b) / greatest(len(a), len(b)), 9) AS similarity FROM pairs")
def damerau_levenshtein(spark, sf_dir):
    p = _name_pairs(spark, sf_dir).withColumn("distance", _damerau("a", "b").cast("long"))
    return p.withColumn("similarity", F.round(1 - F.col("distance") / F.greatest(F.length("a"), F.length("b")), 9))


@query(f"WITH {_TOKENS}, j AS (SELECT a, b, jaro_similarity(a, b) AS j, len(list_filter(range(1, 5), lambda k: k <= least(len(a), len(b)) AND a[1:k] = b[1:k])) AS p FROM pairs) SELECT a, b, round(j, 9) AS jaro, round(CASE WHEN j >= 0.7 THEN j + p * 0.1 * (1 - j) ELSE j END, 9) AS jaro_winkler FROM j")
def jaro_winkler(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("a", "b", F.round(_jaro("a", "b"), 9).alias("jaro"), F.round(_jaro_winkler("a", "b"), 9).alias("jaro_winkler"))


@query(f"WITH {_PAIRS} SELECT a, b, len(list_filter(range(1, 40), lambda k: k <= least(len(a), len(b)) AND a[1:k] = b[1:k])) AS prefix, a = b AS same FROM pairs")
def common_prefix(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", d.common_prefix_col(F.col("a"), F.col("b")).cast("long").alias("prefix"), (F.col("a") == F.col("b")).alias("same"))


@query(f"WITH RECURSIVE {_TOKENS}, cell(a, b, i, j, n) AS (SELECT a, b, i, j, 0 FROM pairs, (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j) WHERE 1 = 0), subs AS (SELECT a, b, m, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda k: CASE WHEN (m >> (k - 1)) & 1 = 1 THEN a[k:k] ELSE NULL END), lambda c: c IS NOT NULL), '%') AS pattern, bit_count(m) AS n FROM pairs, LATERAL (SELECT unnest(range(0, 1 << len(a))) AS m)) SELECT a, b, max(n) AS lcs FROM subs WHERE b LIKE '%' || pattern || '%' GROUP BY a, b")
def longest_common_subsequence(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("a", "b", _lcs("a", "b").cast("long").alias("lcs"))


@query("WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[2] AS noun FROM part WHERE p_name IS NOT NULL) SELECT x.noun AS noun, x.name AS a, y.name AS b FROM n x JOIN n y ON x.noun = y.noun AND x.name < y.name AND levenshtein(x.name, y.name) BETWEEN 2 AND 4")
def near_names_theta_join(spark, sf_dir):
    n = _part_names(spark, sf_dir).withColumn("noun", F.split("name", " ")[1])
    return match.near_name_pairs(n, "name", "noun", 2, 4).select("noun", "a", "b")


@query(f"WITH {_WORDS} SELECT word, list_reduce(list_prepend('', string_split(regexp_replace(lower(word), '[^a-z]|[aeiou]', '', 'g'), '')), lambda s, c: CASE WHEN right(s, 1) = c THEN s ELSE s || c END) AS skeleton FROM words")
def consonant_skeleton(spark, sf_dir):
    return _words(spark, sf_dir).select("word", d.strict_skeleton_col(F.lower("word")).alias("skeleton"))


# Phonetics


@query(f"WITH {_WORDS}, l AS (SELECT word, regexp_replace(lower(word), '[^a-z]', '', 'g') AS x FROM words), k AS (SELECT word, x, x[1:1] || regexp_replace(x[2:], '[hw]', '', 'g') AS y FROM l), c AS (SELECT word, x, list_reduce(list_prepend('', string_split(translate(y, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000'), '')), lambda s, c: CASE WHEN right(s, 1) = c THEN s ELSE s || c END) AS z FROM k) SELECT word, CASE WHEN x = '' THEN '' ELSE (upper(x[1:1]) || replace(z[2:], '0', '') || '000')[1:4] END AS soundex FROM c")
def soundex(spark, sf_dir):
    return _words(spark, sf_dir).select("word", ph.soundex_col("word").alias("soundex"))


@query(f"WITH {_WORDS}, l AS (SELECT word, regexp_replace(lower(word), '[^a-z]', '', 'g') AS x FROM words) SELECT word, CASE WHEN x = '' THEN '' ELSE upper(x[1:1]) || list_reduce(list_prepend('', string_split(translate(x, 'bpfvcksgjqxzdtlmnraeiouyhw', '11223334455566788900000000'), '')), lambda s, c: CASE WHEN right(s, 1) = c THEN s ELSE s || c END) END AS refined FROM l")
def refined_soundex(spark, sf_dir):
    return _words(spark, sf_dir).select("word", ph.refined_soundex_col("word").alias("refined"))


@query()
def phonetic_codes(spark, sf_dir):
    """Double Metaphone, NYSIIS and blocking key, once per distinct word."""
    return _words(spark, sf_dir).withColumn("c", _codes("word")).select("word", "c.*")


@query()
def phonetic_similarity(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("a", "b", F.round(_udf(ph.phonetic_similarity, "double")("a", "b"), 9).alias("similarity"))


# Alias and look-alike indexes


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_ALIASES = sc.alias_rows(sc.MatchOptions())


@query(f"WITH g(id, kind, strength, member) AS (VALUES {_values(_ALIASES)}) SELECT x.member AS a, y.member AS b, max(x.strength) AS strength, count(*) AS shared FROM g x JOIN g y ON x.id = y.id AND x.member < y.member GROUP BY 1, 2")
def alias_index(spark, sf_dir):
    g = spark.createDataFrame(_ALIASES, "id string, kind string, strength double, member string")
    return g.alias("x").join(g.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.member") < F.col("y.member"))).groupBy(F.col("x.member").alias("a"), F.col("y.member").alias("b")).agg(F.max("x.strength").alias("strength"), F.count(F.lit(1)).alias("shared"))


_LOOKALIKES = sorted({tuple(sorted(p)) for p in lex.groups(lex.DISTINCT_PAIRS)})


@query(f"WITH l(lo, hi) AS (VALUES {_values(_LOOKALIKES)}), g(id, kind, strength, member) AS (VALUES {_values(_ALIASES)}), m AS (SELECT DISTINCT member FROM g) SELECT x.member AS a, y.member AS b, EXISTS (SELECT 1 FROM l WHERE lo = x.member AND hi = y.member) AS look_alike FROM m x JOIN m y ON x.member < y.member")
def look_alike_join(spark, sf_dir):
    pairs = spark.createDataFrame(_LOOKALIKES, "a string, b string").withColumn("hit", F.lit(True))
    m = spark.createDataFrame([(x,) for x in sorted({r[3] for r in _ALIASES})], "member string")
    every = m.select(F.col("member").alias("a")).join(m.select(F.col("member").alias("b")), F.col("a") < F.col("b"))
    return every.join(F.broadcast(pairs), ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("look_alike"))


@query()
def token_pair_channels(spark, sf_dir):
    """Score and kind of every pair of part-name words."""

    def channels(a, b):
        return sc.token_channels(a, b, match.resolved(sc.MatchOptions()))[:2]

    return match._pair_frame(_token_pairs(spark, sf_dir), "a", "b", "struct<score:double,kind:string>", channels).select("a", "b", F.round("score", 9).alias("score"), "kind")


@query()
def align_tokens(spark, sf_dir):
    """Coverage and order of the best pairing of words."""

    def work(a, b):
        r = match.resolved(sc.MatchOptions())
        x = sc.align(a.split(" "), b.split(" "), r.tokens)
        return x.coverage, x.core, x.order

    return match._pair_frame(_name_pairs(spark, sf_dir), "a", "b", "struct<coverage:double,core:double,word_order:double>", work)


# Scoring over feature columns

_FEATURE_SQL = {
    "exact": "0", "normalizedExact": "CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END", "compactExact": "CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END", "tokenSimilarity": "(l_orderkey % 101) / 100.0", "tokenOrderSimilarity": "(l_partkey % 11) / 10.0",
    "reordered": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END", "firstNameSimilarity": "(l_partkey % 101) / 100.0", "middleNameSimilarity": "(l_suppkey % 21) / 20.0", "lastNameSimilarity": "(l_suppkey % 101) / 100.0", "firstNameKnown": "1", "lastNameKnown": "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END",
    "editSimilarity": "(l_partkey % 31) / 30.0", "phoneticSimilarity": "(l_orderkey % 41) / 40.0", "initialsSimilarity": "(l_suppkey % 5) / 4.0", "abbreviationSimilarity": "CASE WHEN l_partkey % 4 = 0 THEN 0.8 ELSE 0 END", "aliasSimilarity": "CASE WHEN l_partkey % 6 = 0 THEN 0.9 ELSE 0 END", "transliterationSimilarity": "0",
    "minTokenCount": "1 + l_linenumber % 3", "shortestTokenLength": "1 + l_orderkey % 4", "middleNameOmitted": "CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END", "middleNameConflict": "CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END", "familyNameConflict": "CASE WHEN l_suppkey % 101 < 30 THEN 1 ELSE 0 END", "givenNameConflict": "CASE WHEN l_partkey % 101 < 30 THEN 1 ELSE 0 END",
    "suffixConflict": "CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END", "affixMismatch": "l_orderkey % 2", "distinctNamePenalty": "CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END", "truncationRisk": "CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END", "singleTokenName": "CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END", "crossScript": "CASE WHEN l_orderkey % 31 = 0 THEN 1 ELSE 0 END", "rarityWeightedAgreement": "(l_suppkey % 11) / 10.0",
}
_DECIMAL = re.compile(r"[0-9]+[.][0-9]+")
_W = sc.WEIGHTS
_SCORE_SQL = f"""
WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in _FEATURE_SQL.items())} FROM lineitem),
g AS (SELECT *,
  CASE WHEN "familyNameConflict" > 0 AND "distinctNamePenalty" = 0 THEN 0.55 END AS m1,
  CASE WHEN "givenNameConflict" > 0 AND "distinctNamePenalty" = 0 THEN 0.7 END AS m2,
  CASE WHEN "distinctNamePenalty" > 0 THEN 0.6 END AS m3,
  CASE WHEN "truncationRisk" > 0 THEN 0.85 END AS m4,
  CASE WHEN "middleNameConflict" > 0 THEN 0.6 END AS m5,
  CASE WHEN "lastNameKnown" > 0 AND "familyNameConflict" = 0 AND "distinctNamePenalty" = 0 AND "lastNameSimilarity" >= 0.5 AND "lastNameSimilarity" < 0.78 THEN 0.6 + 0.4 * ("lastNameSimilarity" - 0.5) / 0.28 END AS m6,
  CASE WHEN "firstNameKnown" > 0 AND "givenNameConflict" = 0 AND "distinctNamePenalty" = 0 AND "firstNameSimilarity" >= 0.5 AND "firstNameSimilarity" < 0.78 THEN 0.72 + 0.28 * ("firstNameSimilarity" - 0.5) / 0.28 END AS m7,
  CASE WHEN "suffixConflict" > 0 THEN 0.72 END AS m8,
  CASE WHEN "crossScript" > 0 AND "transliterationSimilarity" = 0 THEN 0.8 END AS m9,
  CASE WHEN "reordered" > 0 THEN 0.97 END AS m10,
  CASE WHEN "middleNameOmitted" > 0 AND "middleNameConflict" = 0 THEN 0.97 END AS m11,
  ({_W["firstName"]}*"firstNameSimilarity" + {_W["lastName"]}*"lastNameSimilarity" + {_W["middleName"]}*"middleNameSimilarity" + {_W["token"]}*"tokenSimilarity" + {_W["edit"]}*"editSimilarity" + {_W["phonetic"]}*"phoneticSimilarity" + {_W["initials"]}*"initialsSimilarity" + {_W["order"]}*"tokenOrderSimilarity" + {_W["abbreviation"]}*"abbreviationSimilarity" + {_W["alias"]}*"aliasSimilarity")
   / ({_W["firstName"]} + {_W["lastName"]} + {_W["middleName"]} + {_W["token"]} + {_W["edit"]} + {_W["phonetic"]} + {_W["initials"]} + {_W["order"]} + CASE WHEN "abbreviationSimilarity" > 0 THEN {_W["abbreviation"]} ELSE 0 END + CASE WHEN "aliasSimilarity" > 0 THEN {_W["alias"]} ELSE 0 END) AS evidence,
  CASE WHEN "firstNameSimilarity" >= 0.99 AND "lastNameSimilarity" >= 0.99 THEN 0.9 + 0.08 * "tokenSimilarity" WHEN "firstNameSimilarity" >= 0.85 AND "lastNameSimilarity" >= 0.99 THEN 0.84 + 0.08 * "tokenSimilarity" WHEN "firstNameSimilarity" >= 0.99 AND "lastNameSimilarity" >= 0.85 THEN 0.82 + 0.08 * "tokenSimilarity" WHEN "firstNameSimilarity" >= 0.8 AND "lastNameSimilarity" >= 0.8 THEN 0.7 + 0.1 * "tokenSimilarity" ELSE 0 END AS floor_,
  least(CASE WHEN "singleTokenName" > 0 AND "normalizedExact" = 0 THEN 0.85 ELSE 1 END, CASE WHEN "minTokenCount" <= 1 AND "rarityWeightedAgreement" < 0.5 THEN 0.7 ELSE 1 END, CASE WHEN "shortestTokenLength" <= 1 AND "minTokenCount" <= 2 THEN 0.88 ELSE 1 END) AS ceiling_
  FROM f),
s AS (SELECT l_orderkey, l_linenumber, CASE
  WHEN "suffixConflict" = 0 AND ("normalizedExact" > 0 OR "compactExact" > 0) THEN least(CASE WHEN "normalizedExact" > 0 THEN 1 ELSE 0.99 END, CASE WHEN "affixMismatch" > 0 THEN 0.985 ELSE 1 END)
  ELSE least(ceiling_, greatest(evidence, CASE WHEN coalesce(m1, m2, m3, m5, m8) IS NULL THEN floor_ ELSE 0 END) * coalesce(m1, 1) * coalesce(m2, 1) * coalesce(m3, 1) * coalesce(m4, 1) * coalesce(m5, 1) * coalesce(m6, 1) * coalesce(m7, 1) * coalesce(m8, 1) * coalesce(m9, 1) * coalesce(m10, 1) * coalesce(m11, 1)) END AS s FROM g)
SELECT l_orderkey, l_linenumber, round(s + 3e-10, 8) AS similarity FROM s
"""


@query(_SCORE_SQL)
def score_features(spark, sf_dir):
    """Gates, floors, ceilings and weighted evidence over made-up features of all line items: native column arithmetic."""
    rows = _table(spark, sf_dir, "lineitem")
    # Literals as doubles, as divisions of decimals would cost more than the arithmetic that is measured.
    f = rows.select("l_orderkey", "l_linenumber", *[F.expr(_DECIMAL.sub(lambda m: m[0] + "D", _FEATURE_SQL.get(k, "0"))).cast("double").alias(k) for k in sc.FEATURES])
    return decide.score_features(f).select("l_orderkey", "l_linenumber", F.round(F.col("similarity") + 3e-10, 8).alias("similarity"))


@query("WITH s AS (SELECT o_orderkey, (o_orderkey % 1001) / 1000.0 AS s FROM orders), t AS (SELECT o_orderkey, s, CAST(floor(1 + 99 * s + 0.5) AS INTEGER) AS score FROM s) SELECT o_orderkey, score, CASE WHEN score >= 85 THEN 'very-high' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'very-low' END AS confidence, CASE WHEN score >= 95 THEN 'extremely-strong' WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'likely' WHEN score >= 50 THEN 'possible' WHEN score >= 30 THEN 'weak' ELSE 'very-weak' END AS band, round((score - 1) / 99.0, 9) AS back, round(least(1 - 1e-9, greatest(1e-9, 1 / (1 + exp(-(17.727131 * s - 12.778914))))), 8) AS probability FROM t")
def score_map(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1001 / 1000.0).alias("s"))
    o = o.withColumn("score", decide.to_score(F.col("s")))
    return o.select("o_orderkey", "score", decide.confidence_of(F.col("score")).alias("confidence"), decide.band_of(F.col("score")).alias("band"), F.round(decide.from_score(F.col("score")), 9).alias("back"), F.round(decide.probability_of(F.col("s")), 8).alias("probability"))


# Evaluation

_SCORED = "scored AS (SELECT o_orderkey, o_orderpriority AS category, CAST(1 + (o_orderkey * 37 + o_custkey * 11) % 100 AS INTEGER) AS score, CASE WHEN (o_orderkey * 37 + o_custkey * 11) % 100 + o_custkey % 41 >= 80 THEN 'match' ELSE 'different' END AS expected, 'n' || o_custkey % 97 AS a, 'n' || o_orderkey % 89 AS b FROM orders)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.expr("(o_orderkey * 37 + o_custkey * 11) % 100")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), (1 + mixed).cast("int").alias("score"), F.when(mixed + F.col("o_custkey") % 41 >= 80, "match").otherwise("different").alias("expected"), F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("a"), F.concat(F.lit("n"), F.col("o_orderkey") % 89).alias("b"))


_COUNTS = "count(*) FILTER (score >= 75 AND expected = 'match') AS tp, count(*) FILTER (score >= 75 AND expected <> 'match') AS fp, count(*) FILTER (score < 75 AND expected <> 'match') AS tn, count(*) FILTER (score < 75 AND expected = 'match') AS fn, count(*) AS total"


@query(f"WITH {_SCORED}, c AS (SELECT category, {_COUNTS} FROM scored GROUP BY ROLLUP (category)), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c) SELECT category, tp, fp, tn, fn, total, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 9) AS f1, round((tp + tn) / total, 9) AS accuracy, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 9) AS fpr, round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END, 9) AS fnr FROM r")
def metrics_by_category(spark, sf_dir):
    m = evaluate.metrics(_scored(spark, sf_dir), 75, "category")
    return m.select("category", "tp", "fp", "tn", "fn", "total", *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1", "accuracy", "fpr", "fnr")])


@query(f"WITH {_SCORED}, t AS (SELECT unnest(range(1, 101)) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND expected = 'match') AS tp, count(*) FILTER (score >= threshold AND expected <> 'match') AS fp, count(*) FILTER (expected = 'match') AS p FROM t CROSS JOIN scored GROUP BY threshold) SELECT CAST(threshold AS INTEGER) AS threshold, tp, fp, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + p) END, 9) AS f1 FROM c")
def sweep_thresholds(spark, sf_dir):
    return evaluate.sweep_thresholds(_scored(spark, sf_dir)).select("threshold", "tp", "fp", F.round("f1", 9).alias("f1"))


@query(f"WITH {_SCORED}, r AS (SELECT expected, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored) SELECT round((sum(r) FILTER (expected = 'match') - count(*) FILTER (expected = 'match') * (count(*) FILTER (expected = 'match') + 1) / 2) / (count(*) FILTER (expected = 'match') * count(*) FILTER (expected <> 'match')), 9) AS auc FROM r")
def area_under_roc(spark, sf_dir):
    return evaluate.area_under_roc(_scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_SCORED} SELECT o_orderkey, score, CASE WHEN score >= 75 THEN 'fp' ELSE 'fn' END AS kind FROM scored WHERE (score >= 75) <> (expected = 'match') ORDER BY kind DESC, CASE WHEN score >= 75 THEN -score ELSE score END, a, b, o_orderkey LIMIT 1000000000")
def worst_cases(spark, sf_dir):
    return evaluate.worst_cases(_scored(spark, sf_dir), 75, None).select("o_orderkey", "score", "kind")


@query(f"WITH {_SCORED} SELECT o_orderkey, a, b FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY o_orderkey) AS k FROM scored) WHERE k = 1")
def dedupe_pairs(spark, sf_dir):
    return evaluate.dedupe_pairs(_scored(spark, sf_dir), "o_orderkey").select("o_orderkey", "a", "b")


@query(f"WITH {_SCORED} SELECT category, count(*) FILTER (expected = 'match') AS \"match\", count(*) FILTER (expected = 'different') AS different FROM scored GROUP BY category")
def summarise(spark, sf_dir):
    return evaluate.summarise(_scored(spark, sf_dir))


@query(f"WITH {_SCORED}, m(mode, threshold) AS (VALUES ('strict', 88), ('balanced', 75), ('fuzzy', 62)) SELECT category AS dataset, mode, count(*) FILTER (score >= threshold AND expected = 'match') AS tp, count(*) FILTER (score >= threshold AND expected <> 'match') AS fp, count(*) FILTER (score < threshold AND expected = 'match') AS fn, count(*) FILTER (score < threshold AND expected <> 'match') AS tn FROM scored CROSS JOIN m GROUP BY 1, 2")
def validation_matrix(spark, sf_dir):
    return evaluate.validation_matrix(_scored(spark, sf_dir).withColumnRenamed("category", "dataset"), {k: v[0] for k, v in sc.MODES.items()})


@query(f"WITH {_SCORED} SELECT a, o_orderkey, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, o_orderkey) AS k FROM scored) WHERE k <= 3")
def top_k_per_query(spark, sf_dir):
    w = Window.partitionBy("a").orderBy(F.desc("score"), "o_orderkey")
    return _scored(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("a", "o_orderkey", "score", "rank")


@query()
def fit_calibration(spark, sf_dir):
    s = _scored(spark, sf_dir).select(((F.col("score") - 1) / 99).alias("similarity"), (F.col("expected") == "match").cast("int").alias("label"))
    slope, intercept, n = evaluate.fit_calibration(s)
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6), n)], "slope double, intercept double, n long")


@query(f"WITH {_PAIRS}, g AS (SELECT a, b, list_distinct(list_transform(range(1, len(a)), lambda i: a[i:i + 1])) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: b[i:i + 1])) AS y FROM pairs) SELECT a, b, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS dice FROM g")
def bigram_dice(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(evaluate.bigram_dice("a", "b"), 9).alias("dice"))


# Linkage


@query()
def blocking_join(spark, sf_dir):
    """Candidate pairs of part names with each other by shared keys, scored."""
    n = _part_names(spark, sf_dir)
    x, y = n.select(F.col("name").alias("x"), F.col("name").alias("xn")), n.select(F.col("name").alias("y"), F.col("name").alias("yn"))
    pairs = match.candidate_pairs(x, y, "x", "y", "xn", "yn").where("xn < yn")
    return match.similarity_score(pairs, "xn", "yn").select("xn", "yn", "score")


@query()
def stream_static_scoring(spark, sf_dir):
    """The stateless scorer on a batch frame: part names against those with the same noun."""
    n = _part_names(spark, sf_dir).withColumn("noun", F.split("name", " ")[1])
    return score_stream(n.withColumnRenamed("name", "a"), n.withColumnRenamed("name", "b"), "noun", "a", "b").select("a", "b", "score", "matched")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
