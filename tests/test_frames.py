import pytest

from spark_onoma.functions import scoring as sc
from spark_onoma.operators import decide, evaluate, match
from spark_onoma.sources.pairs import load_dataset


def test_match_names_handles_nulls_repeats_and_clashes(spark):
    rows = [("Bob Smith", "Robert Smith", 1), ("Bob Smith", "Robert Smith", 2), (None, "John", 3), (None, None, 4), ("John Smith", "John Smith", 5)]
    out = {r["k"]: r for r in match.match_names(spark.createDataFrame(rows, "a string, b string, k int")).collect()}
    assert {k: r["score"] for k, r in out.items()} == {1: 92, 2: 92, 3: 1, 4: 100, 5: 100} and out[1]["matched"] and out[1]["confidence"] == "very-high"
    assert match.match_names(spark.createDataFrame([], "a string, b string")).count() == 0


def test_detailed_and_native_scores_agree(spark):
    pairs = spark.createDataFrame([("Bob Smith", "Robert Smith"), ("John Michael Smith", "John Smith"), ("Raj Kumar", "Rajesh Kumar")], "a string, b string")
    detailed = {r["a"]: r for r in match.match_names(pairs, options=sc.MatchOptions(detailed=True)).collect()}
    native = {r["a"]: r for r in decide.score_features(match.extract_features(pairs)).collect()}
    assert {k: r["score"] for k, r in detailed.items()} == {k: r["score"] for k, r in native.items()}
    assert any("nickname" in m for m in detailed["Bob Smith"]["reasons"])


def test_ranking_breaks_ties_by_position(spark):
    c = spark.createDataFrame([("Jon Smith", 0), ("Peter Jones", 1), ("John Smith", 2)], "candidate string, at int")
    out = match.rank_names(spark.createDataFrame([("John Smith",)], "query string"), c, 2, position="at").orderBy("rank").collect()
    assert [r["candidate"] for r in out] == ["John Smith", "Jon Smith"]


def test_blocking_finds_nicknames(spark):
    left, right = spark.createDataFrame([(1, "Peggy Wilson")], "l int, x string"), spark.createDataFrame([(7, "Margaret Wilson"), (8, "Zoltan Bartok")], "r int, y string")
    assert [r["r"] for r in match.candidate_pairs(left, right, "l", "r", "x", "y").collect()] == [7]


def test_metrics_and_auc(spark):
    s = spark.createDataFrame([("match", 90, "x", "a", "b"), ("different", 80, "x", "a", "c"), ("match", 40, "y", "a", "d"), ("different", 10, "y", "b", "a")], "expected string, score int, category string, a string, b string")
    total = evaluate.metrics(s, 75, "category").where("category is null").first()
    assert (total["tp"], total["fp"], total["fn"], total["tn"]) == (1, 1, 1, 1) and evaluate.area_under_roc(s).first()["auc"] == pytest.approx(0.75)
    assert evaluate.dedupe_pairs(s, "score").count() == 3 and evaluate.worst_cases(s, 75).first()["kind"] == "fp"


def test_training(spark):
    s = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "x array<double>, label int")
    w, b = evaluate.train_logistic(s, iterations=40)
    p = {r["label"]: r["p"] for r in s.withColumn("p", decide.predict_probability(w, b)).select("label", "p").distinct().collect()}
    assert p[1] > 0.6 > 0.5 > p[0]
    slope, _, n = evaluate.fit_calibration(spark.createDataFrame([(i / 200, int(i >= 100)) for i in range(200)], "similarity double, label int"))
    assert slope > 12 and n == 200


def test_dataset_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"pairs": [{"a": "x", "b": "y", "expected": "match", "category": "c"}]}')
    assert load_dataset(spark, str(tmp_path / "p.json")).first()["expected"] == "match"


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["a", "b", "score"]
