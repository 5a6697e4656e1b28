"""Line deduplication by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.scratch import Scratch

#: A variable field.
WILDCARD = "<*>"
SPACES = r"[ \t\x0b\f\r]+"
#: Places that a line's tokens after the leading one are dealt to; a place is what is kept or generalised.
PLACES = 5


def masked(line: Column) -> Column:
    """A line with single spaces, tokens that hold a digit masked."""
    plain = F.trim(F.regexp_replace(line, SPACES, " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILDCARD)).otherwise(plain)


def line_keys(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """(doc_id, line_no, h1, h2, places) of every line with at least ``min_tokens`` tokens; blank lines never take part.

    h1 and h2 are 128 bits of the masked line. ``places`` are hashes of the line's leaf (token count and leading token),
    a place's number and its tokens: place k of K holds token j of the m after the leading one if j * K / m is k, whole.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", masked(F.col("line")).alias("x")).where("x <> ''")
    lines = lines.select("doc_id", "line_no", "x", F.split("x", " ").alias("t"))
    m = F.size("t") - 1
    border = lambda k: F.ceil(m * k / PLACES).cast("int")
    width = lambda k: border(k + 1) - border(k)
    place = lambda k: F.when(width(k) > 0, F.xxhash64(m, F.col("t")[0], F.lit(k), F.slice("t", border(k) + 2, F.greatest(width(k), F.lit(1)))))
    places = F.when(m > 2, F.array_compact(F.array(*(place(k) for k in range(PLACES)))))
    return lines.where(F.size("t") >= min_tokens).select("doc_id", "line_no", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"), places.alias("places"))


def generalised(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, g1, g2): the masked lines whose leaf generalises them, and what is left of them.

    The support of a place's tokens is the number of lines of the leaf that have them there. A place varies if its
    support is at most half of what half of the line's places reach. The rest is a template if it keeps at least two
    places and, with the leading token, three of five, and if at least half of the lines that have its rarest place follow it.
    """
    fields = keyed.where("places is not null").select("h1", "h2", F.size("places").alias("m"), F.explode("places").alias("field"))
    support = scratch.save(fields.groupBy("field").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = fields.join(support, "field").groupBy("h1", "h2", "m").agg(F.collect_set(F.struct("field", "n")).alias("shared"), F.count(F.lit(1)).alias("seen"))
    every = F.sort_array(F.concat(F.col("shared.n"), F.array_repeat(F.lit(1).cast("long"), F.col("m") - F.size("shared"))), asc=False)
    shared = shared.where(F.size("shared") > 1).withColumn("middle", F.element_at(every, F.ceil(F.col("m") / 2).cast("int")))
    kept = shared.select("h1", "h2", "m", (F.col("seen") / F.size("shared")).cast("long").alias("lines"), F.filter("shared", lambda x: 2 * x["n"] > F.col("middle")).alias("kept"), "middle")
    kept = kept.where((F.col("middle") > 1) & (F.size("kept") < F.col("m")) & (F.size("kept") > 1) & (5 * (F.size("kept") + 1) >= 3 * (F.col("m") + 1)))
    own = F.array_sort(F.col("kept.field"))
    open_lines = scratch.save(kept.select("h1", "h2", F.xxhash64(own).alias("g1"), F.xxhash64(F.lit(1), own).alias("g2"), "lines", F.array_min("kept.n").alias("least")))
    firm = open_lines.groupBy("g1", "g2").agg(F.sum("lines").alias("lines"), F.max("least").alias("least")).where("2 * lines >= least").select("g1", "g2")
    return scratch.save(open_lines.join(firm, ["g1", "g2"]).select("h1", "h2", "g1", "g2"))


def recurring(docs: DataFrame, min_docs: int = 2, min_tokens: int = 1) -> DataFrame:
    """(doc_id, line_no) of the lines to drop: their template is in ``min_docs`` documents or more, and not first here.

    Lines are parsed once and only hashes of them written to the shared folder; no text is shuffled. Supports and first
    documents come from aggregates that every task starts on its own lines. What they are joined with has exchanges
    of its own, so the adaptive planner can split the partition of a line that a third of the corpus holds.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = scratch.save(line_keys(docs, min_tokens))
    wider = generalised(keyed, scratch)
    if min_docs <= 2:
        lines = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        known = scratch.save(lines.join(wider, ["h1", "h2"], "left").where("g1 is not null or first_doc < last_doc"))
        firsts = known.where("g1 is not null").groupBy("g1", "g2").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")).where("first_doc < last_doc").select("g1", "g2", "first_doc")
        found = known.where("g1 is null").select("h1", "h2", "first_doc").unionByName(known.where("g1 is not null").select("h1", "h2", "g1", "g2").join(firsts, ["g1", "g2"]).select("h1", "h2", "first_doc"))
    else:
        named = keyed.select("doc_id", "h1", "h2").join(wider, ["h1", "h2"], "left").select("h1", "h2", "doc_id", F.coalesce("g1", "h1").alias("k1"), F.coalesce("g2", "h2").alias("k2"), F.col("g1").isNotNull().alias("wide"))
        firsts = named.groupBy("wide", "k1", "k2", "doc_id").agg(F.lit(1).alias("one")).groupBy("wide", "k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
        found = named.select("wide", "k1", "k2", "h1", "h2").distinct().join(firsts, ["wide", "k1", "k2"]).select("h1", "h2", "first_doc")
    found = scratch.save(found)
    return keyed.select("doc_id", "line_no", "h1", "h2").join(found, ["h1", "h2"]).where("doc_id > first_doc").select("doc_id", "line_no")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, min_tokens: int = 1) -> DataFrame:
    """The documents without lines whose template an earlier document (by id) has; adds ``n_lines, n_dropped``.

    A line's template is the line with its variable fields generalised: tokens that hold a digit, and what varies among
    the lines of its leaf in the template tree (see ``generalised``). Lines end at a line feed. Blank lines and lines of
    fewer than ``min_tokens`` tokens always stay, as do the lines of the first document with a template, repeats within
    one document and rows with a null id. Null text stays null with no line; a document that loses all its lines stays
    with an empty text. Rows that share an id count as one document whose line numbers are dropped in each. Other
    columns pass through whatever their names; columns named as the added ones, in any case, are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    gone = recurring(docs.select("doc_id", "text").where("doc_id is not null"), min_docs, min_tokens).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    own, marked = docs.alias("own"), gone.alias("marked")
    out = own.join(marked, F.col("own.doc_id") == F.col("marked.doc_id"), "left")
    lines, lost = F.split("own.text", "\n"), F.col("marked.gone")
    stay = F.struct(lines.alias("x"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost).alias("at"))
    left = F.transform(F.array(stay), lambda s: F.array_join(F.transform(s["at"], lambda i: s["x"][i]), "\n"))[0]
    text = F.when(lost.isNull(), F.col("own.text")).otherwise(left)
    return out.select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"own.`{c}`") for c in keep],
        F.when(F.col("own.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_dropped"),
    )


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents),
tokens AS (
  SELECT doc_id, line_no,
         list_transform(string_split(trim(regexp_replace(line, '[ \t\x0b\f\r]+', ' ', 'g'), ' '), ' '),
                        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
  FROM lines),
masked AS (SELECT doc_id, line_no, t, array_to_string(t, ' ') AS x FROM tokens WHERE t <> ['']),
placed AS (
  SELECT x, m, lead, k, array_to_string(list(w ORDER BY j), ' ') AS field
  FROM (SELECT x, t[1] AS lead, len(t) - 1 AS m, j, j * {PLACES} // (len(t) - 1) AS k, t[j + 2] AS w
        FROM (SELECT x, t, unnest(range(len(t) - 1)) AS j FROM (SELECT DISTINCT x, t FROM masked) WHERE len(t) > 3))
  GROUP BY x, m, lead, k),
counts AS (SELECT x, count(*) AS lines FROM masked GROUP BY x),
support AS (SELECT m, lead, k, field, sum(lines) AS n FROM placed JOIN counts USING (x) GROUP BY ALL),
leaf_lines AS (
  SELECT x, m, lead, list({{'k': k, 'field': field, 'n': n}} ORDER BY k) AS places
  FROM placed JOIN support USING (m, lead, k, field) GROUP BY x, m, lead),
kept AS (
  SELECT x, m, lead, len(places) AS size,
         list_filter(places, lambda p: 2 * p.n > list_reverse_sort(list_transform(places, lambda q: q.n))[CAST(ceil(len(places) / 2.0) AS INT)]) AS own
  FROM leaf_lines),
open_lines AS (
  SELECT x, lines, m, lead, list_transform(own, lambda p: {{'k': p.k, 'field': p.field}}) AS g, list_min(list_transform(own, lambda p: p.n)) AS least
  FROM kept JOIN counts USING (x) WHERE len(own) < size AND len(own) > 1 AND 5 * (len(own) + 1) >= 3 * (size + 1)),
firm AS (SELECT m, lead, g FROM open_lines GROUP BY m, lead, g HAVING 2 * sum(lines) >= max(least)),
wider AS (SELECT x, m, lead, g FROM open_lines JOIN firm USING (m, lead, g)),
templates AS (
  SELECT doc_id, line_no, CASE WHEN g IS NULL THEN x ELSE CAST({{'m': m, 'lead': lead, 'g': g}} AS VARCHAR) END AS template, g IS NULL AS plain
  FROM masked LEFT JOIN wider USING (x)),
firsts AS (SELECT plain, template, min(doc_id) AS first_doc FROM templates GROUP BY plain, template HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, line_no FROM templates JOIN firsts USING (plain, template) WHERE doc_id > first_doc),
kept_lines AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL) AS text,
         count(*) AS n_lines, count(g.line_no) AS n_dropped
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
       CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, k.n_dropped AS n_dropped
FROM documents d JOIN kept_lines k USING (doc_id)
"""
