"""Matching names in DataFrames: pair scoring, ranking, features, blocking joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spark_onoma.functions import names as nm
from spark_onoma.functions import scoring as sc
from spark_onoma.functions.distance import strict_skeleton_col
from spark_onoma.functions.phonetic import phonetic_key
from spark_onoma.operators.decide import band_of, confidence_of, probability_of, to_score


@lru_cache(maxsize=8)
def resolved(options: sc.MatchOptions) -> sc.Resolved:
    """A worker's indexes for some options, with its memo of word pairs."""
    return sc.Resolved(options)


NAME_TYPE = "struct<original:string,normalized:string,compact:string,tokens:array<string>,titles:array<string>,suffixes:array<string>,script:string,transliterated:boolean,comma_inverted:boolean>"
PARSED_TYPE = "struct<given:array<string>,middle:array<string>,family:array<string>,suffix:array<string>,title:array<string>,tokens:array<string>,ambiguous:boolean>"
REASON_TYPE = "array<struct<code:string,message:string,polarity:string,weight:int>>"
ALIGNMENT_TYPE = "array<struct<a:string,b:string,score:double,kind:string>>"


def _fields(record) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in record.__dict__.items()}


#: Results that a task remembers at most.
MEMO = 1 << 16


def _once(frame: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` over the columns in one pass without a shuffle; a task remembers the results of values it has seen.

    Other columns pass through untouched; those of an added name are replaced.
    """
    out = T._parse_datatype_string(schema)
    frame = frame.select(*[F.col(f"`{c}`") for c in frame.columns if c not in out.names])
    places = [frame.columns.index(c) for c in columns]
    kinds = T.StructType([*frame.schema.fields, *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in to_arrow_schema(out)]
        memo: dict[tuple, tuple] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            rows = []
            for key in zip(*(batch.column(k).to_pylist() for k in places), strict=True):
                if key not in memo:
                    memo[key] = work(*key)
                rows.append(memo[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=kinds.names)

    # By place, as names with dots cannot be looked up.
    return frame.toDF(*(f"c{k}" for k in range(len(frame.columns)))).mapInArrow(run, kinds)


def normalize_names(frame: DataFrame, column: str, options: nm.NormalizeOptions = nm.NormalizeOptions(), to: str = "readings") -> DataFrame:
    """Adds the one or two readings of each name; a null name has one empty reading."""
    return _once(frame, [column], f"struct<{to}:array<{NAME_TYPE}>>", lambda x: ([_fields(n) for n in nm.normalize_variants(x, options)],))


def parse_names(frame: DataFrame, column: str, options: nm.ParseOptions = nm.ParseOptions(), normalize: nm.NormalizeOptions = nm.NormalizeOptions(), to: str = "parsed") -> DataFrame:
    """Adds given, middle and family parts."""
    return _once(frame, [column], f"struct<{to}:{PARSED_TYPE}>", lambda x: (_fields(nm.parse_name(x, options, normalize)),))


def _pair_frame(pairs: DataFrame, a: str, b: str, schema: str, work) -> DataFrame:
    return _once(pairs, [a, b], schema, work)


def match_names(pairs: DataFrame, a: str = "a", b: str = "b", options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """Adds ``score, matched, confidence`` (and with ``detailed`` band, probability, features, parts, evidence).

    Pairs are scored in one pass where they lie. Pairs that are equal as written skip the kernel unless details or a slow
    path are asked for. Null names count as empty; two empty names score 100, one empty name scores 1.
    """
    if options.detailed:
        return _detailed(pairs, a, b, options)

    def work(x, y):
        r = resolved(options)
        if options.fast_path:
            if x is not None and x == y and any("a" <= c.lower() <= "z" for c in x):
                return (1.0,)
            p, q = nm.normalize(x, options.normalize), nm.normalize(y, options.normalize)
            if p.normalized and (p.normalized, p.titles, p.suffixes) == (q.normalized, q.titles, q.suffixes):
                return (1.0,)
        return (sc.best_evaluation(x, y, r)[0],)

    return _decide(_pair_frame(pairs, a, b, "struct<similarity:double>", work), options)


def _decide(scored: DataFrame, options: sc.MatchOptions) -> DataFrame:
    score = to_score(F.col("similarity"))
    return scored.withColumn("score", score).withColumn("matched", F.col("score") >= options.resolved_threshold).withColumn("confidence", confidence_of(F.col("score")))


def _detailed(pairs: DataFrame, a: str, b: str, options: sc.MatchOptions) -> DataFrame:
    schema = f"struct<similarity:double,features:struct<{','.join(f'{k}:double' for k in sc.FEATURES)}>,parts:struct<a:{NAME_TYPE},b:{NAME_TYPE}>,parsed:struct<a:{PARSED_TYPE},b:{PARSED_TYPE}>,evidence:{REASON_TYPE},alignment:{ALIGNMENT_TYPE}>"

    def work(x, y):
        s, e = sc.best_evaluation(x, y, resolved(options))
        against = [] if not e.features["suffixConflict"] and (e.features["normalizedExact"] or e.features["compactExact"]) else sc.gates(e.features, options.sensitivity)
        lines = [{"a": p[0], "b": p[1], "score": p[2], "kind": p[3]} for p in e.alignment.pairs]
        lines += [{"a": t, "b": None, "score": 0.0, "kind": "unmatched"} for t in e.alignment.left] + [{"a": None, "b": t, "score": 0.0, "kind": "unmatched"} for t in e.alignment.right]
        return s, {k: float(v) for k, v in e.features.items()}, dict(zip("ab", map(_fields, e.names), strict=True)), {k: _fields(nm.parse_normalized(n, options.parse)) for k, n in zip("ab", e.names, strict=True)}, sc.explain(e, against), lines

    out = _decide(_pair_frame(pairs, a, b, schema, work), options)
    return out.withColumn("band", band_of(F.col("score"))).withColumn("probability", probability_of(F.col("similarity"))).withColumn("reasons", F.transform("evidence", lambda r: r["message"])).withColumn("model", F.lit("heuristic"))


def similarity_score(pairs: DataFrame, a: str = "a", b: str = "b", options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """Adds ``score`` alone."""
    return match_names(pairs, a, b, options).drop("similarity", "matched", "confidence")


def extract_features(pairs: DataFrame, a: str = "a", b: str = "b", options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """Adds the 38 features of the best pair of readings as columns."""
    schema = "struct<" + ",".join(f"{k}:double" for k in sc.FEATURES) + ">"
    return _pair_frame(pairs, a, b, schema, lambda x, y: tuple(float(v) for v in sc.best_evaluation(x, y, resolved(options))[1].features.values()))


def rank_names(queries: DataFrame, candidates: DataFrame, limit: int | None = None, query: str = "query", candidate: str = "candidate", position: str | None = None, options: sc.MatchOptions = sc.MatchOptions(), block: Column | None = None) -> DataFrame:
    """(query, candidate, score, matched, rank): candidates by score, ties by ``position`` (or the candidate).

    Without ``block`` every query meets every candidate, which is meant for few queries; with it, a boolean column over
    both frames (for example equal phonetic keys) decides which pairs are scored.
    """
    both = queries.crossJoin(candidates) if block is None else queries.join(candidates, block)
    scored = match_names(both, query, candidate, options)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(position or candidate))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


class NameMatcher:
    """A matcher with its options settled; ``match``, ``score`` and ``rank`` take DataFrames."""

    def __init__(self, options: sc.MatchOptions = sc.MatchOptions()) -> None:
        self.options = options

    def match(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        return match_names(pairs, a, b, self.options)

    def score(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        return similarity_score(pairs, a, b, self.options)

    def rank(self, queries: DataFrame, candidates: DataFrame, limit: int | None = None, **names) -> DataFrame:
        return rank_names(queries, candidates, limit, options=self.options, **names)


def clear_caches() -> None:
    """Forget this process's memos."""
    resolved.cache_clear()
    nm.normalize_variants.cache_clear()


def blocking_keys(frame: DataFrame, name: str, options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """One row per name and key: phonetic key, alias groups and (rare) first letter with family of its words."""

    def keys(text):
        r = resolved(options)
        found = set()
        for n in nm.normalize_variants(text, options.normalize):
            found |= {f"p:{phonetic_key(t)}" for t in n.tokens if len(t) > 1} | {f"a:{g}" for t in n.tokens for g in r.groups.get(t, {})} | {f"c:{n.compact}"}
            if n.tokens:
                found.add(f"i:{''.join(sorted(t[0] for t in n.tokens))}")
        return (sorted(found),)

    return _once(frame, [name], "struct<keys:array<string>>", keys).withColumn("key", F.explode("keys")).drop("keys")


def candidate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """Distinct pairs of rows that share a blocking key; the join is an equi-join that the planner may split."""
    x = blocking_keys(left.select(left_id, left_name), left_name, options)
    y = blocking_keys(right.select(right_id, right_name), right_name, options)
    return x.join(y, "key").select(left_id, left_name, right_id, right_name).distinct()


def near_name_pairs(names: DataFrame, column: str, group: str, low: int, high: int) -> DataFrame:
    """Pairs of one group at an edit distance from low to high: a theta join with the group as its equi key."""
    x, y = names.select(group, F.col(column).alias("a")), names.select(group, F.col(column).alias("b"))
    return x.join(y, group).where((F.col("a") < F.col("b")) & F.levenshtein("a", "b", high).between(low, high))


def skeleton_block(column: str) -> Column:
    """A native blocking key: the consonant skeleton."""
    return strict_skeleton_col(F.lower(F.col(column)))
