import itertools
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spark_onoma.llm import decontaminate, graph, html_text, language, line_dedup, near_dup, packing, span_dedup, textops, token_file, tokenise, toxicity, vector_dedup
from spark_onoma.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Null and empty texts, a null id, copies, a near copy, a long text, repeated rows, a clashing column."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    texts = [None, "", " \n ", " ".join(base), " ".join(base), " ".join(near), "ab", "ab cd", " ".join(word() for _ in range(30_000)), "Licensed under terms 1.0\nown line here now", "Licensed under terms 2.0\nother line here now"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a b c d e f g", None, None, None), (9, texts[9], "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates_against_brute_force(spark, docs):
    out = near_dup.near_duplicates(docs, 3, 85).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == 13 and got[3][1:] == (3, True) and got[4][1:] == got[5][1:] == (3, False)
    assert got[0] == (0, 0, True) and got[6] == (1, 6, True) and got[7] == (1, 7, True) and got[None][1:] == (None, True)
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    copy = spark.createDataFrame([(None, docs.collect()[3]["text"]), (3, docs.collect()[3]["text"])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(copy).collect()} == {(None, None, True), (3, 3, True)}


def test_near_duplicates_large_group(spark):
    """A bucket above the listed size whose members link along a chain."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(200), 2):
            words = [*words[:k], f"x{i}{k}", *words[k + 1 :]]
    sets = [{tuple(t.split()[j : j + 3]) for j in range(198)} for _, t in rows]
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == root


def chain(seed, n, size):
    """Texts that change by two words from one to the next, so that they link along a chain, and their Jaccard classes."""
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(size)], []
    for i in range(n):
        texts.append(" ".join(words))
        for k in rng.sample(range(size), rng.choice([2, 2, 12])):
            words = [*words[:k], f"x{i}{k}", *words[k + 1 :]]
    sets = [{tuple(t.split()[j : j + 3]) for j in range(size - 2)} for t in texts]
    root = list(range(n))
    while True:
        old = list(root)
        for i, j in itertools.combinations(range(n), 2):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
        if root == old:
            return texts, root


@pytest.mark.parametrize("volume,member", [(2_000, 1), (300, 1)])
def test_near_duplicates_past_every_block(spark, monkeypatch, volume, member):
    """Buckets above the listed size, in one block and in many, and a filter of ids or a join with them."""
    monkeypatch.setattr(near_dup, "VOLUME", volume)
    monkeypatch.setattr(near_dup, "MEMBER", member)
    monkeypatch.setattr(near_dup, "LISTED", 3)
    monkeypatch.setattr(near_dup, "FILTER_IDS", volume // 100)
    texts, root = chain(21, 70, 150)
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == root and len(set(root)) > 3


def test_shared_counts_against_sets(monkeypatch):
    monkeypatch.setattr(near_dup, "_DENSE", 16)
    rng = np.random.default_rng(4)
    sides = [[np.unique(rng.integers(-60, 60, rng.integers(0, 50))) for _ in range(n)] for n in (7, 11)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sides[1]] for x in sides[0]]
    assert near_dup.shared_counts(*sides).tolist() == want
    assert near_dup.shared_counts(sides[0], []).shape == (7, 0) and near_dup.shared_counts([sides[0][0][:0]], [sides[0][0][:0]]).tolist() == [[0]]


def _block(n, size):
    """A block of a bucket: five families of sets of which parts differ."""
    rng = np.random.default_rng(5)
    draw = lambda *shape: rng.integers(-(2**63), 2**63 - 1, shape)
    base = draw(5, size)
    sets = [np.unique(np.where(rng.random(size) < 0.4 * rng.random(), draw(size), base[rng.integers(5)])) for _ in range(n)]
    return pa.table({"part": rng.integers(0, n, n), "loose": rng.random(n) < 0.5, "items": textops.list_array(np.concatenate(sets), np.array([len(x) for x in sets]), pa.int64())})


@pytest.mark.parametrize("cut,strip", [(1 << 18, 256), (64, 7)])
def test_links_of_a_block_against_sets(monkeypatch, cut, strip):
    monkeypatch.setattr(near_dup, "_SLICE", cut)
    monkeypatch.setattr(near_dup, "_STRIP", strip)
    table = _block(120, 60)
    part, loose, sets = table["part"].to_pylist(), table["loose"].to_pylist(), [set(x) for x in table["items"].to_pylist()]
    root = {p: p for p in part}
    while True:
        old = dict(root)
        for i, j in itertools.product(range(120), repeat=2):
            if loose[i] and not loose[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[part[i]] = root[part[j]] = min(root[part[i]], root[part[j]])
        if root == old:
            break
    got = near_dup._linker(80)[0](table)
    assert dict(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == {p: r for p, r in root.items() if p != r} and len(got) > 5


def test_memory_of_a_block():
    """Beside its sets a block needs less than five times their memory (more than six times before values were dealt to slices)."""
    table = _block(1000, 1000)
    tracemalloc.start()
    near_dup._linker(80)[0](table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * table["items"].nbytes


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 50, 50: 50}


def test_line_dedup_matches_sql(spark, docs):
    rows = docs.where("doc_id is not null").distinct()
    got = line_dedup.drop_recurring_lines(rows)
    con = duckdb.connect()
    con.register("documents", rows.toArrow())
    want = con.sql(line_dedup.SQL)
    assert sorted(map(repr, got.select(want.columns).toPandas().values.tolist())) == sorted(map(repr, want.df().values.tolist()))
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()}[10] == 1 and line_dedup.drop_recurring_lines(empty(spark)).count() == 0


def test_line_templates_generalise_fields(spark):
    """Word-valued fields of two templates, a line of its own in the same leaf, and clashing or dotted column names."""
    rows = [(i, f"user {n} logged in from host {h} today\nPosted by {n} in {h}\nuser of this house has one wide roof", n) for i, (n, h) in enumerate(zip("anna carl dora emil".split(), "red blue pink gray".split(), strict=True))]
    rows.append((7, "user anna was never here at all, ever\nPosted on a wall somewhere", "x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").selectExpr("*", "1 as __id", "2 as gone", "3 as N_DROPPED", "struct(4 as doc_id) as own")
    out = line_dedup.drop_recurring_lines(frame)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["a.b"], r["__id"]) for r in out.collect()}
    assert got == {0: (rows[0][1], 3, 0, "anna", 1), **{i: ("", 3, 3, rows[i][2], 1) for i in (1, 2, 3)}, 7: (rows[4][1], 2, 0, "x", 1)}
    assert out.columns == ["doc_id", "text", "a.b", "__id", "gone", "own", "n_lines", "n_dropped"]
    three = line_dedup.drop_recurring_lines(frame.where("doc_id < 2 or doc_id = 7"), min_docs=3).collect()
    assert [r["n_dropped"] for r in three] == [0, 0, 0]


def test_line_dedup_random_leaves_against_sql(spark):
    """Few words in few leaves, so that supports tie and templates overlap."""
    rng = random.Random(31)
    rows = [(i, "\n".join(" ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 14]))) for _ in range(rng.randrange(30))), "en", "s", 0) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    want = con.sql(line_dedup.SQL)
    assert sorted(map(tuple, line_dedup.drop_recurring_lines(frame).select(want.columns).collect())) == sorted(want.fetchall())


def test_line_stage_of_the_pipeline_takes_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "Les.\n\nAnd ornd.\nown first line", "en", "s", 0), (2, "Les.\n\nsecond text\nAnd ornd.\n ", "en", "s", 0), (3, "\n ", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {1: rows[0][1], 2: "\nsecond text\n ", 3: rows[2][1]}


def test_span_dedup(spark, docs):
    shared = "One short sentence stands here today. Another sentence follows it closely now. A third one ends this passage well. "
    rows = [(1, f"Alpha beta gamma. {shared}Own end."), (2, f"Quite another start. {shared}Last words."), (3, "Clean text stays. It has its own words. Nothing repeats in it at all, not once, nor twice.")]
    got = {r["doc_id"]: r for r in span_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[2]["text"] == "Quite another start. Last words." and got[2]["first_doc_ids"] == [1]
    assert span_dedup.drop_repeated_spans(docs).count() == 13 and span_dedup.drop_repeated_spans(empty(spark)).count() == 0


@pytest.mark.parametrize("stops", [0, 30])
def test_every_repeat_of_fifty_words_has_a_common_run(stops):
    """Passages of 50 words in other surroundings, with and without punctuation, and of few different words."""
    rng = random.Random(12)
    for vocabulary in (1, 3, 500):
        word = lambda: f"v{rng.randrange(vocabulary)}" + "." * (rng.randrange(1000) < stops)  # noqa: B023, E731
        texts = []
        for _ in range(300):
            passage = [word() for _ in range(50)]
            texts += [" ".join([*(f"x{rng.random()}" for _ in range(rng.randrange(30))), *passage, *(f"y{rng.random()}" for _ in range(rng.randrange(30)))]) for _ in range(2)]
        data = [t.encode() for t in texts]
        words = textops.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        starts, unit, _, key = span_dedup.runs(words, span_dedup.RUN, span_dedup.MIN_WORDS)
        found = [set(key[words.doc[starts[unit]] == row].tolist()) for row in range(len(texts))]
        assert all(found[i] & found[i + 1] for i in range(0, len(texts), 2))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    v = np.concatenate([base, base + 0.05 * rng.standard_normal((20, 16)), rng.standard_normal((60, 16))])
    rows = [(i, [float(x) for x in row], int(i % 3 == 0)) for i, row in enumerate(v)] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] + [1.0] * 15, 0), (204, [float(x) for x in v[0]], None)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:100]])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(100, dtype=bool)
    assert [got[i]["n_links"] for i in range(100)] == link.sum(1).tolist() and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 205))


def test_tokens_equal_the_library():
    tool, rng = tokenise.Encoder(tokenise.default_tokenizer()), random.Random(2)
    bits = ["a", "B", "é", "'", "'s", "'re", " ", "  ", "\n", "1", "²", "!", "ß", "…", "don't", "中", " \n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(2000)]
    want = [x.ids for x in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, _, ids, sizes in tokenise.encoded(pa.array(texts), tokenise.default_tokenizer(), 1):
        got += [x[:-1].tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want


def test_tokens_of_long_texts():
    rng = random.Random(9)
    bits = ["word", " of", "  two", "\n", " 1", "'s", " Straße", "中", " ", "!"]
    texts = ["".join(rng.choices(bits, k=400_000)), "x" * 700_000, "", "ab " * 300_000]
    tool, parts = tokenise.Encoder(tokenise.default_tokenizer()), [len(tokenise.portions(np.frombuffer(t.encode(), np.uint8))) for t in texts]
    assert parts[0] > 2 and parts[1:3] == [1, 1] and parts[3] > 2
    for text, (_, _, ids, sizes) in zip(texts, tokenise.encoded(pa.array(texts), tokenise.default_tokenizer(), 1), strict=True):
        assert ids.tolist() == [*tool.tokenizer.encode(text, add_special_tokens=False).ids, 1] and sizes.tolist() == [len(ids)]


def test_packing_finds_the_cheapest_room():
    """Against a plain search of all sequences; items of full cost stand before many cheaper ones without room."""

    def plain(lengths, limit):
        count = -(-sum(lengths) // limit)
        used, cost, out = [0] * count, [0.0] * count, set()
        for i in sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: (-lengths[i], i)):
            n = lengths[i]
            fits = [s for s in range(count) if used[s] + n <= limit]
            if fits:
                s = min(fits, key=lambda s: (cost[s], used[s], s))
                out.add((i, s, used[s]))
                used[s] += n
                cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        return out

    rng = random.Random(18)
    trials = [[rng.choice([1500, 1300, 800, 790, 560, 520, 480, 450, 130]) for _ in range(600)] for _ in range(10)] + [[rng.randrange(2048) for _ in range(700)] for _ in range(5)] + [[], [0], [5]]
    for lengths in trials:
        want, got = plain(lengths, 2048), packing.pack_rests(lengths, 2048)
        assert {(i, s, at) for i, start, n, s, at in got if n == lengths[i]} >= want
        assert sum(n for _, _, n, _, _ in got) == sum(lengths)


def test_added_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    path = tokenise.default_tokenizer()
    mark = "<|endoftext|>"
    texts = ["plain", f"a {mark} b", "", mark, f"{mark}{mark} x", "<|endoftext", "|> none", f"中 {mark}", "ab " * 300_000 + mark + " end" * 9]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = [x[:-1].tolist() for _, _, ids, sizes in tokenise.encoded(pa.array(texts), path, 1) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want and 50256 in got[1]


def test_packing_is_whole(spark, docs):
    rows = packing.packed_sequences(docs.where("doc_id is not null").distinct()).collect()
    ids = {i: t for i, t in zip(range(11), [x for _, _, a, s in tokenise.encoded(pa.array([r["text"] for r in docs.limit(11).collect()]), tokenise.default_tokenizer(), 1) for x in np.split(a, np.cumsum(s)[:-1])], strict=True)}
    for doc, own in ids.items():
        pieces = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == doc)
        assert [x for _, p in pieces for x in p] == own.tolist()
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
        assert at <= 2048
    assert packing.packed_sequences(empty(spark)).count() == 0


@pytest.mark.parametrize("values", [[], [0], list(range(5000)), [0] * 3000, [1 << 63, 5, (1 << 60) - 1, 1 << 60] * 900])
def test_simple8b_round_trip(values):
    shard = token_file.encode(np.array(values, np.uint64))
    assert token_file.decode(shard).tolist() == values and token_file.decode(shard, 1, 2).tolist() == values[1024:2048]


def test_token_file(spark, docs):
    rows = token_file.token_digest(docs.where("doc_id is not null").distinct()).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert len(rows) == 11 and rows[0]["n_tokens"] == 1 and token_file.token_digest(empty(spark)).count() == 0


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "and", "with"] if i % 2 else ["und", "mit", "das"], k=20)), "en" if i % 2 else "de") for i in range(120)] + [(200, None, "en"), (201, "12 34!", None), (202, "", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(frame, language.fit_languages(frame)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120)) and [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    none = language.identify(frame, language.fit_languages(frame.limit(0)))
    assert none.count() == 123


def test_decontamination(spark):
    rng = random.Random(6)
    item = [f"term{i}" for i in range(40)]
    worn = [w if i % 9 else "other" for i, w in enumerate(item)]
    fill = [f"fill{rng.randint(0, 500)}" for _ in range(60)]
    rows = [(1, " ".join([*fill, *item, *fill])), (2, " ".join([*fill, *worn]).upper()), (3, " ".join(fill)), (4, None), (5, " ".join(item[:8]))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "x"), (3, "seven small words make this item whole")], "item_id long, text string")
    frame = spark.createDataFrame([*rows, (6, "So: seven small words make this item whole, indeed")], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flag_contaminated(frame, bench).collect()}
    assert got == {1: [0], 2: [0], 3: [], 4: [], 5: [], 6: [3]}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()) == [3, 4, 5]


def test_seeds_meet_every_overlap():
    for n in range(13, 26):
        for differ in itertools.combinations(range(n), n // 5):
            same = "".join("0" if i in differ else "1" for i in range(n))
            assert "1111" in same or any(same[i : i + 3] == same[i + 4 : i + 7] == "111" for i in range(n - 6)), same
    assert decontaminate.MASKS == ("1111", "1110111")


def test_overlap_on_a_whole_diagonal(spark):
    """Qualifying windows away from the first seed of their diagonal, beside worn text, and random ones by brute force."""
    rng = random.Random(16)
    item = [f"term{i}" for i in range(57)]
    other = lambda n: [f"x{rng.random()}" for _ in range(n)]
    later = [*item[:10], *other(25), *item[35:]]
    core = [*item[:13], *(w if i % 10 < 7 else other(1)[0] for i, w in enumerate(item[13:43]))]
    worn = [w if i % 4 else other(1)[0] for i, w in enumerate(item)]
    rows = [(1, " ".join([*other(9), *later, *other(9)])), (2, " ".join([*other(9), *core, *other(9)])), (3, " ".join([*worn, *other(5)]))]
    for i in range(4, 40):
        share = rng.choice([0.5, 0.65, 0.75])
        rows.append((i, " ".join([*other(rng.randrange(9)), *(w if rng.random() < share else other(1)[0] for w in item), *other(rng.randrange(9))])))

    def best(words):
        found = (0, 0)
        for shift in range(-57, len(words)):
            same = [0 <= i + shift < len(words) and words[i + shift] == w for i, w in enumerate(item)]
            for a in range(max(0, -shift), 57):
                for b in range(a + 13, min(57, len(words) - shift) + 1):
                    if 5 * (n := sum(same[a:b])) >= 4 * (b - a):
                        found = max(found, (n, a - b))
        return found

    want = {i: -size for i, t in rows for n, size in [best(t.split())] if n}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(frame, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert {1, 2} <= found.keys() and found.keys() == want.keys()
    for i, r in found.items():
        assert r["length"] == want[i] and 5 * r["matches"] >= 4 * r["length"]


def test_short_items_are_searched_whole(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 13)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(99, "")], "item_id long, text string")
    rows, want = [], {}
    for n, item in items.items():
        for count in range(4):
            for differ in itertools.combinations(range(n), count):
                want[len(rows)] = [n] if n - count >= 0.8 * n else []
                rows.append((len(rows), " ".join(["a", *(w if k not in differ else "b" for k, w in enumerate(item)), "c"])))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flag_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_html():
    inner, outer, found = html_text.blocks('<head><title>t</title></head><nav>menu</nav><article><h1>A &amp; B</h1><p>x<b>y</b> z<br>w<aside>no</aside><div class="share">no</div></p><script>"</p>"</script><p>end&nbsp;&lt;</article><footer>f</footer>')
    assert found and inner == ["A & B", "xy z", "w", "end <"] and outer == []
    pages = [["same"] * 3 + ["q", "r", "s", "t", f"own{i}", f"mine{i}"] for i in range(3)]
    assert [m.tolist() for m in html_text.repeated(pages, 6)] == [[True] * 7 + [False] * 2] * 3


def test_html_frame(spark):
    boiler = "one two three four five six seven"
    rows = [(i, f"http://h.example/{i}", f"<div>{boiler}</div><div>page{i} is my own</div>") for i in range(4)] + [(9, None, None), (10, "http://h.example/x", "<article>kept twice</article>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "page0 is my own", 1: "page1 is my own", 2: "page2 is my own", 3: "page3 is my own", 9: "", 10: "kept twice"}


def test_html_of_a_large_host(spark):
    """Repeats on a few pages of a host of several times HOST_PAGES pages; the want is one suffix array over all."""
    rng = random.Random(14)
    boilers = [" ".join(f"b{k}x{i}" for i in range(n)) for k, n in enumerate((5, 6, 7, 20))]
    rows = []
    for i in range(3 * html_text.HOST_PAGES):
        blocks = [" ".join(f"w{rng.randrange(20)}" for _ in range(rng.randrange(12))), f"own{i}", *(b for b in boilers if rng.random() < 0.01)]
        rng.shuffle(blocks)
        rows.append((i % 500, f"http://large.example/{i % 500}", "".join(f"<div>{b}</div>" for b in blocks) + ("<article>a text</article>" if i % 50 == 0 else "")))
    rows += [(1000, "http://large.example/none", None), (1001, "http://small.example/", f"<div>{boilers[3]}</div>")]
    pages = [[w for b in html_text.blocks(h or "")[1] for w in b.split(" ")] for _, _, h in rows[:-1]]
    want = [" ".join(w for w, gone in zip(words, mask, strict=True) if not gone) for words, mask in zip(pages, html_text.repeated(pages), strict=True)]
    want = [(r[0], "a text" if "<article" in (r[2] or "") else t) for r, t in zip(rows, [*want, boilers[3]], strict=True)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(want) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_toxicity(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["calm", "tree", "river", "stone"], k=30)) + (" scumbag" if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (301, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels)).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(400)) and got[900]["score"] == got[901]["score"] < 0.7
    assert toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels.limit(0))).count() == 402


def test_pipeline_on_a_fixture(spark, tmp_path):
    """Near copies by whole lines, of which the line stage leaves scraps or nothing; a rejected text, a benchmark passage."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(80)]
    lines = "\n".join(" ".join(f"l{i}x{k}" for k in range(12)) for i in range(9))
    texts = [" ".join(base), " ".join([*base[:79], "z"]), "12 34", " ".join(f"t{i}" for i in range(30)), "clean words of its own stay here", lines, lines + "\nwith one more line", lines]
    rows = [(i, t, None if i == 2 else "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(f"t{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in got}) == [0, 4, 5] and all(r["doc_tokens"] > 1 for r in got)


def test_rows_of_one_id_link_by_any_text(spark):
    words = [[f"{c}{i}" for i in range(40)] for c in "abcd"]
    text = [" ".join(w) for w in words]
    near = [" ".join([*w[:39], "end"]) for w in words]
    rows = [(1, text[0]), (2, near[0]), (2, text[1]), (3, near[1]), (4, text[2]), (5, text[2]), (5, text[3]), (6, text[3]), (7, "of its own"), (8, ""), (8, near[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(frame, 3, 85).where("n_shingles > 0").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 4)}
    docs = spark.createDataFrame([(2, "x"), (3, "y"), (6, "z"), (7, "v"), (9, "w"), (None, "u")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_dup.keep_one(docs, 3, 85, texts=frame).collect()) == ["u", "v", "w", "x", "z"]


CLASHES = "id ID2 spans first_doc_ids mark_id gone marked own kept component_id n_shingles band bands bucket part held_out LANG_PRED Score item_ids n_items N_LINES width raw toxic feature spot row host side".split()


@pytest.fixture
def rough(spark, docs):
    """The awkward documents with columns whose names operators use, upper-case and dotted ones too, and no row at all."""
    wide = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES], "1 AS `a.b`")
    return wide, wide.limit(0)


def test_document_operators_take_any_columns_and_rows(spark, rough, tmp_path):
    labels = spark.createDataFrame([(0, 0, 1), (3, 1, 1), (9, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, pos int")
    bench = spark.createDataFrame([(0, "a b c d e f g", 1), (None, "x", 2), (2, None, 3), (0, "a b c d e f g", 1)], "item_id long, text string, doc_id long")
    for frame, rows in zip(rough, (13, 0), strict=True):
        model = language.fit_languages(frame)
        found = {
            "line": line_dedup.drop_recurring_lines(frame), "span": span_dedup.drop_repeated_spans(frame), "near": near_dup.near_duplicates(frame), "file": token_file.token_digest(frame), "language": language.identify(frame, model),
            "leak": decontaminate.flag_contaminated(frame, bench), "no leak": decontaminate.flag_contaminated(frame, bench.limit(0)), "toxic": toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels)),
        }
        for name, out in found.items():
            out.write.parquet(str(tmp_path / f"{name}{rows}"))
            got = spark.read.parquet(str(tmp_path / f"{name}{rows}"))
            assert got.count() == rows + 4 * (name in ("leak", "no leak") and rows and 0), name
        assert decontaminate.drop_contaminated(frame, bench).count() == max(0, rows - 1) and near_dup.keep_one(frame).count() == max(0, rows - 2)
        pieces = packing.packed_sequences(frame).collect()
        assert len({r["doc_id"] for r in pieces}) == (12 if rows else 0)


def test_vectors_and_pages_take_any_columns_and_rows(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.01], 0, "x"), (None, [1.0, 0.0], 0, "x"), (3, [], 0, "x"), (4, [1.0], 0, "x"), (5, [float("inf"), 1.0], 0, "x"), (6, [1e300, 1e300], 0, "x"), (7, [1e-300, 1e-300], 0, "x")], "vec_id long, embedding array<double>, label int, id string").selectExpr("*", "1 AS dims", "2 AS own", "3 AS `a.b`", "4 AS N_LINKS")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(vectors).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]
    assert vector_dedup.near_vectors(vectors.limit(0)).count() == 0
    long = "<article>" + "word &amp; " * 200_000 + "</article>"
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (None, None, "<div>y</div>"), (2, "nonsense", None), (3, "http://a/2", ""), (4, "http://a/3", long)], "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS host", "3 AS text", "4 AS `a.b`", "5 AS N_CHARS")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_text.main_text(pages).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 7 * 200_000 - 1)] and html_text.main_text(pages.limit(0)).count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 24))
    v = np.concatenate([base + s * rng.standard_normal((30, 24)) for s in (0, 0.1, 0.2, 0.3)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & ~np.eye(120, dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame([(i, [float(x) for x in row], 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    missed = link.sum() - sum(got.values())
    assert all(got[i] <= link[i].sum() for i in range(120)) and missed <= 0.02 * link.sum()


def test_html_labels_and_open_elements():
    page = '<article><p class="social-science">a</p><p id="notice-board">b</p><div class="share-buttons">no</div><div class="comment_list x">no</div><form>c<p>d</p></article>'
    assert html_text.blocks(page)[0] == ["a", "b", "c", "d"]
    assert html_text.blocks("<article>a<form>no</form>b</article>")[0] == ["a", "b"]


def test_benchmark_in_several_blocks(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [[word() for _ in range(20)] for _ in range(30)]
    texts = [" ".join([word() for _ in range(40)] + (items[i][:14] if i % 3 == 0 else []) + [word() for _ in range(9)]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert len(list(decontaminate.indexes(bench))) == 6
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()} == {(i, i) for i in range(0, 30, 3)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {i for i in range(30) if i % 3}
