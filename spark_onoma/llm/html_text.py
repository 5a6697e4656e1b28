"""Main text of web pages: block parsing, and a suffix array over the pages of a host for what markup does not tell."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.scratch import Scratch
from spark_onoma.llm.textops import Words, chunks, grams

#: Words of the shortest repeat that counts as boilerplate.
MIN_REPEAT = 6
#: Pages of a host that one suffix array spans at most; repeats of larger hosts are found by joining hashes of runs.
HOST_PAGES = 256

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe select button xmp noembed noframes".split())
BOILER = frozenset("nav footer aside form menu dialog head".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
LABELS = frozenset("nav navbar navigation menu header masthead footer sidebar ad ads advert adverts advertisement promo sponsored banner cookie cookies consent notice alert comment comments respond share sharing social related newsletter subscribe breadcrumb breadcrumbs widget modal popup login signup search pagination".split())
#: Words that may stand beside a label in a class or id; beside any other word a label does not count (social-science).
PLACES = frozenset("site page post article entry main top bottom left right upper lower first last side bar box list item items wrap wrapper container content section block area panel inner outer links link icons icon buttons button bar row col column slot unit area text title form field message popup global primary secondary footer header js no is has the a 1 2 3 4 5 6 7 8 9 0".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\s_-]+")


def _labelled(token: str) -> bool:
    """Does a class or id name boilerplate? Some part of it is a label and no part says otherwise."""
    parts = _WORD.findall(token)
    return any(w in LABELS for w in parts) and all(w in LABELS or w in PLACES for w in parts)


def _excluded(name: str, attributes: str, inside: bool) -> bool:
    """Does an element hold boilerplate by its name, role, class or id? ``inside``: it stands in the article."""
    if name in BOILER or name == "header" and not inside:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ROLES:
                return True
        elif name not in ("article", "main", "body", "html") and any(_labelled(w) for w in value.split()):
            return True
    return False


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of the article, blocks outside it, whether there is an article); boilerplate by markup is left out of both."""
    inner: list[str] = []
    outer: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    bad = inside = found = False
    at, lower = 0, None

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                (inner if inside else outer).append(text)

    while m := _TAG.search(page, at):
        if m.start() > at and not bad:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in BLOCK or name in RAW:
            close()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    bad, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            if end >= 0:
                at = end if (stop := page.find(">", end)) < 0 else stop + 1
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if not bad and _excluded(name, attributes, inside):
            # An element that nothing closes would hide all that follows.
            lower = page.lower() if lower is None else lower
            bad = (lower if len(lower) == len(page) else page).find(f"</{name}", at) >= 0
        if not bad and (name in ("article", "main") or 'role="main"' in attributes):
            inside = found = True
        stack.append((name, bad, inside))
    if at < len(page) and not bad:
        parts.append(page[at:])
    close()
    return inner, outer, found


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(tokens)
    rank, step = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n and step < n:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        order = np.lexsort((second, rank))
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank, step = fresh, 2 * step
        if rank.max() == n - 1:
            break
    return order


def repeated(pages: list[list[str]], least: int = MIN_REPEAT) -> list[np.ndarray]:
    """Per page a mask of its words that lie in a run of ``least`` words or more that another page has too."""
    names: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    for p, words in enumerate(pages):
        stream += [names.setdefault(w, len(names)) for w in words] + [-1 - p]
        owner += [p] * (len(words) + 1)
    n = len(stream)
    order = suffix_array(np.array(stream, np.int64))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    order_list, rank_list = order.tolist(), rank.tolist()
    common = [0] * (n + 1)
    k = 0
    for i in range(n):
        r = rank_list[i]
        if r:
            j = order_list[r - 1]
            while i + k < n and j + k < n and stream[i + k] == stream[j + k] and stream[i + k] >= 0:
                k += 1
            common[r] = k
        k = max(0, k - 1)
    reach = [0] * n
    for line in (range(1, n), range(n - 2, -1, -1)):
        best, step = 0, 1 if line.step == 1 else -1
        for r in line:
            shared = common[r] if step == 1 else common[r + 1]
            best = min(shared, best) if owner[order_list[r]] == owner[order_list[r - step]] else shared
            reach[order_list[r]] = max(reach[order_list[r]], best)
    mark = np.zeros(n + 1, np.int64)
    length = np.array(reach, np.int64)
    start = np.flatnonzero(length >= least)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + length[start], -1)
    covered, out, at = np.cumsum(mark)[:-1] > 0, [], 0
    for words in pages:
        out.append(covered[at : at + len(words)])
        at += len(words) + 1
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, sides, mains = [], [], []
        for page in batch.column(2):
            inner, outer, found = blocks(page.as_py() or "")
            texts.append(" ".join(inner))
            sides.append(outer)
            mains.append(found)
        rows = pa.array(np.arange(at, at + batch.num_rows))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string()), pa.array(sides, pa.list_(pa.string())), pa.array(mains, pa.bool_())], names=["row", "page_id", "url", "host", "text", "side", "main"])


def _unique_runs(table: pa.Table) -> pa.Table:
    sides, mains = table["side"].to_pylist(), table["main"].to_pylist()
    open_rows = [r for r, m in enumerate(mains) if not m]
    texts = {}
    if open_rows:
        words = [[w for b in side for w in b.split(" ")] for side in sides]
        masks = repeated(words)
        texts = {r: " ".join(w for w, gone in zip(words[r], masks[r], strict=True) if not gone) for r in open_rows}
    rows = pa.array(open_rows, pa.int64())
    return pa.table({"page_id": table["page_id"].take(rows), "url": table["url"].take(rows), "text": pa.array([texts[r] for r in open_rows], pa.string())})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, site, words) to a row for each run of ``MIN_REPEAT`` words: its hash and its first word."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(2)):
            words = Words(data, offsets, lower=False)
            key = grams(words.hash, MIN_REPEAT)
            start = np.flatnonzero(words.doc[: len(key)] == words.doc[len(words.doc) - len(key) :])
            page = pa.array(words.doc[start])
            own = [batch.column(k).slice(first, last - first).take(page) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(key[start].view(np.int64)), pa.array((start - words.bounds[words.doc[start]]).astype(np.int32))], names=["row", "site", "run", "at"])


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, runs in zip(batch.column(2), batch.column(3), strict=True):
            words = page.as_py().split(" ")
            gone = np.zeros(len(words), dtype=bool)
            if runs.is_valid:
                at = runs.values.to_numpy(zero_copy_only=False)
                for k in range(MIN_REPEAT):
                    gone[at + k] = True
            texts.append(" ".join(w for w, x in zip(words, gone, strict=True) if not x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _large_hosts(pages: DataFrame, kind: str) -> DataFrame:
    """Unique runs of the open pages of hosts of any size, as ``repeated`` over the whole host would leave them.

    A word lies in a run of ``MIN_REPEAT`` words or more that another page has if and only if it lies in a run of just
    ``MIN_REPEAT`` words that another page has, so runs of that length are hashed (64 bits) and joined by host. Minima
    and maxima of their pages tell what several pages have; every task takes them of its own runs before the exchange.
    """
    source = pages.select("row", F.xxhash64("host").alias("site"), F.array_join("side", " ").alias("words"), "page_id", "url", "main")
    schema = "row long, site long, run long, at int"
    shared = source.select("row", "site", "words").mapInArrow(_runs, schema).groupBy("site", "run").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("site", "run")
    own = source.where("not main").select("row", "site", "words").mapInArrow(_runs, schema)
    marks = own.join(shared, ["site", "run"]).groupBy(F.col("row").alias("marked")).agg(F.collect_list("at").alias("runs"))
    left = source.where("not main").join(marks, F.col("row") == F.col("marked"), "left").select("page_id", "url", "words", "runs")
    return left.mapInArrow(_cut_runs, f"page_id {kind}, url string, text string")


def main_text(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its article, blocks joined by one space.

    Elements that their name, role, class or id marks as boilerplate go. What is in <article>, <main> or role=main is
    then the text, repeats included. For a page without such an element, the blocks that are left are compared with
    those of the host's other pages (all pages' blocks outside their articles): a suffix array over the pages' words
    finds runs of at least ``MIN_REPEAT`` words that other pages repeat, and only unique runs stay. Hosts of more than
    ``HOST_PAGES`` pages, too many for one array, get the same text from a join of the hashes of their runs.

    Null html counts as empty and gives an empty text; null ids and urls are kept (a null url is a host of its own
    kind); repeated rows are pages of their own; an empty table gives no row; other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    source = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    kind = source.schema["page_id"].dataType.simpleString()
    parsed = scratch.save(source.mapInArrow(_parse, f"row long, page_id {kind}, url string, host string, text string, side array<string>, main boolean"))
    counts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.bool_and("main").alias("done")).where("not done").select("host", "pages")
    # Dealt anew by both columns: else the planner keeps the deal by host, and a large host's pages meet the join in one task.
    small = parsed.join(counts.where(F.col("pages") <= HOST_PAGES), "host").select("host", "pages", "page_id", "url", "side", "main").repartition("host", "pages").groupBy("host", "pages").applyInArrow(_unique_runs, f"page_id {kind}, url string, text string")
    large = _large_hosts(parsed.join(counts.where(F.col("pages") > HOST_PAGES), "host"), kind)
    return parsed.where("main").select("page_id", "url", "text").unionByName(small).unionByName(large).withColumn("n_chars", F.length("text").cast("long"))
