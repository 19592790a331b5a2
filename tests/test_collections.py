import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vantor.errors import BudgetExceeded, Duplicate, InvalidParameter, UnknownCollection, UnknownPayloadField, UnknownPoint, UnknownTable, UnknownVector, UnsupportedMetric, WrongColumnType
from vantor.functions import sparse
from vantor.operators import fusion, late, mutations, operations, search
from vantor.plans import query
from vantor.plans.formula import Formula
from vantor.sources.catalog import Catalog
from vantor.sources.tokens import register_late_interaction, repair_late_interaction


def make(spark, rows, schema, vector="embedding", dims=2, metric="l2"):
    c = Catalog(spark)
    c.register_table("docs", spark.createDataFrame(rows, schema))
    c.create_collection("docs", "docs")
    if vector:
        c.register_vector("docs", "dense", vector, dims, metric)
    c.backfill_points("docs")
    return c


def keys(df):
    return [r["source_key"] for r in df.collect()]


@pytest.fixture(scope="module")
def basic(spark):
    rows = [(10, [3.0, 0.0], "acme", "open", '{"topic": "rust"}'), (20, [1.0, 0.0], "other", "open", '{"topic": "db"}'), (30, [2.0, 0.0], "acme", "closed", "{}"), (40, [0.5, 0.0], "acme", "open", None), (50, None, "acme", "open", '{"topic": null}')]
    c = make(spark, rows, "id long, embedding array<float>, tenant_id string, status string, metadata string")
    c.register_filter_column("docs", "tenant", "tenant_id")
    c.register_filter_column("docs", "status", "status")
    c.register_json_path("docs", "topic", "metadata", ["topic"])
    return c


ACME = {"must": [{"key": "tenant", "match": "acme"}]}


def test_search(basic):
    assert keys(search.search(basic, "docs", [0.0, 0.0], 10)) == ["40", "20", "30", "10"]
    assert keys(search.search(basic, "docs", [0.0, 0.0], 2, filter=ACME)) == ["40", "30"]
    ids = {r["source_key"]: r["point_id"] for r in basic.active(basic.exact("docs")).collect()}
    assert keys(search.search(basic, "docs", [0.0, 0.0], 5, candidates=[ids["10"], ids["30"], ids["30"], 999])) == ["30", "10"]
    assert search.count(basic, "docs", ACME).first()[0] == 4
    assert [tuple(r) for r in search.facet(basic, "docs", "status", ACME).collect()] == [("open", 3), ("closed", 1)]
    assert [tuple(r) for r in search.facet(basic, "docs", "topic").collect()] == [("db", 1), ("rust", 1)]
    assert [(r[0], r[2]) for r in search.grouped_search(basic, "docs", [0.0, 0.0], "tenant", 1, 10).collect()] == [("acme", "40"), ("other", "20")]
    for limit in (0, -1, 10_001, True):
        with pytest.raises(InvalidParameter):
            search.search(basic, "docs", [0.0, 0.0], limit)
    with pytest.raises(InvalidParameter):
        search.search(basic, "docs", [0.0], 1)
    with pytest.raises(UnknownCollection):
        search.search(basic, "nope", [0.0, 0.0], 1)
    with pytest.raises(UnknownVector):
        search.search(basic, "docs", [0.0, 0.0], 1, name="nope")
    with pytest.raises(UnknownPayloadField):
        search.facet(basic, "docs", "nope")


def test_ties_go_to_the_smaller_point(spark):
    assert [tuple(r) for r in search.inline(spark, [0.0], [9, 3, 5], [[1.0], [1.0], [0.0]], "l2", 3).collect()] == [(5, 0.0), (3, 1.0), (9, 1.0)]
    with pytest.raises(InvalidParameter):
        search.inline(spark, [0.0], [1], [], "l2", 1)
    with pytest.raises(InvalidParameter):
        search.inline(spark, [0.0], [-1], [[1.0]], "l2", 1)
    rows = search.inline_sparse(spark, "{1:1}/3", [1, 2], ["{1:2}/3", "{2:5}/3"], "inner_product", 2).collect()
    assert [tuple(r) for r in rows] == [(1, -2.0), (2, 0.0)]


def test_points(spark):
    c = make(spark, [(i, [float(i)]) for i in range(1, 6)], "id int, embedding array<float>", dims=1)
    ids = {r["source_key"]: r["point_id"] for r in c.active(c.exact("docs")).collect()}
    assert ids == {str(i): i for i in range(1, 6)}
    assert keys(c.delete_points("docs", ["2", "2", "99", "3"]).orderBy("point_id")) == ["2", "3"]
    assert keys(search.search(c, "docs", [0.0], 10)) == ["1", "4", "5"]
    report = {r["source_key"]: (r["point_id"], r["inserted"], r["reactivated"]) for r in c.upsert_points("docs", ["2", "1", "7", "7", None]).collect()}
    assert report == {"2": (2, False, True), "1": (1, False, False), "7": (6, True, False)}
    assert keys(search.search(c, "docs", [0.0], 10)) == ["1", "2", "4", "5"]  # 7 has no source row
    batches = [tuple(r) for r in c.bulk_delete_points("docs", ["1", "2", "x"], 2).orderBy("batch_number").collect()]
    assert batches == [(1, 2, 2, 0), (2, 1, 0, 1)]
    assert [r["point_id"] for r in search.scroll(c, "docs", None, 2).collect()] == [4, 5]
    cursor = search.scroll(c, "docs", None, 1).first()["next_cursor"]
    assert [r["point_id"] for r in search.scroll(c, "docs", cursor, 10).collect()] == [5, 6]
    assert search.decode_cursor(search.encode_cursor(3, 77), 3) == 77
    for bad in ("", "v1:1:2", "v2:1:2:0", cursor[:-1] + ("0" if cursor[-1] != "0" else "1"), search.encode_cursor(99, 1)):
        with pytest.raises(InvalidParameter):
            search.decode_cursor(bad, 1)


def test_empty_collection(spark):
    c = make(spark, [], "id int, embedding array<float>")
    assert search.search(c, "docs", [0.0, 0.0], 3).collect() == []
    assert search.count(c, "docs").first()[0] == 0
    assert c.upsert_points("docs", []).collect() == []


def test_registration_rules(spark):
    c = Catalog(spark)
    c.register_table("t", spark.createDataFrame([], "id int, v array<float>, w array<float>, name string, n int"))
    c.create_collection("a", "t")
    with pytest.raises(Duplicate):
        c.create_collection("a")
    with pytest.raises(UnknownTable):
        c.create_collection("b", "nope")
    c.create_alias("al", "a")
    with pytest.raises(Duplicate):
        c.create_collection("al")
    with pytest.raises(Duplicate):
        c.create_alias("a", "a")
    c.register_vector("a", "v", "v", 2, "l2")
    for args, e in (
        (("v", "w", 2, "l2"), Duplicate), (("x", "v", 2, "l2"), Duplicate), (("w", "w", 0, "l2"), InvalidParameter), (("w", "w", 2, "hamming"), UnsupportedMetric), (("w", "w", 2, "x"), InvalidParameter),
        (("w", "zz", 2, "l2"), UnknownPayloadField), (("w", "name", 2, "l2"), WrongColumnType),
    ):
        with pytest.raises(e):
            c.register_vector("a", *args)
    with pytest.raises(WrongColumnType):
        c.register_sparse_vector("a", "s", "w", 2, "l2")
    c.register_vector("a", "w", "w", 2, "cosine")
    with pytest.raises(InvalidParameter, match="specify"):
        search.search(c, "al", [0.0, 0.0], 1)
    c.register_filter_column("a", "name", "name")
    with pytest.raises(Duplicate):
        c.register_filter_column("a", "other", "name")
    with pytest.raises(WrongColumnType):
        c.register_json_path("a", "p", "n", ["x"])
    with pytest.raises(UnknownCollection):
        c.register_filter_column("al", "n", "n")  # aliases count for retrieval only
    c.configure_limits("a", strict_mode=True, max_search_limit=5)
    with pytest.raises(BudgetExceeded):
        search.search(c, "a", [0.0, 0.0], 6, name="v")
    with pytest.raises(InvalidParameter):
        c.configure_limits("a", max_points=0)
    assert c.configure_vector("a", "v", {"m": 16}, {}, "building").status == "building"
    assert c.collection_vectors("a").count() == 2 and c.collection_info("al").first()["collection_name"] == "a"
    assert c.drop_alias("al") and not c.drop_alias("al") and c.drop_collection("a") and not c.drop_collection("a")


def test_models_and_migrations(spark):
    c = Catalog(spark)
    c.create_collection("a")
    c.register_model_version("a", "m", "1", 8, "l2")
    c.register_model_version("a", "m", "2", 8, "l2")
    with pytest.raises(Duplicate):
        c.register_model_version("a", "m", "1", 8, "l2")
    with pytest.raises(InvalidParameter):
        c.create_migration("a", ("m", "1"), ("m", "1"), 10)
    m = c.create_migration("a", ("m", "1"), ("m", "2"), 10)
    assert c.update_migration(m["migration_id"], 7, "running")["processed_points"] == 7
    assert c.update_migration(m["migration_id"], 3, "planned")["processed_points"] == 3
    with pytest.raises(InvalidParameter):
        c.update_migration(1, 11, "running")
    assert c.embedding_migrations().first()["status"] == "planned" and c.model_versions().count() == 2


def test_save_and_load(spark, basic, tmp_path):
    basic.create_alias("again", "docs")
    basic.save(str(tmp_path / "c"))
    c = Catalog.load(spark, str(tmp_path / "c"))
    c.register_table("docs", basic.tables["docs"])
    assert keys(search.search(c, "again", [0.0, 0.0], 10, filter=ACME)) == ["40", "30", "10"]
    basic.drop_alias("again")


def test_recommend_discover_lookup(spark):
    c = make(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [8.0, 0.0]), (4, [0.0, 4.0])], "id int, embedding array<float>")
    assert keys(search.recommend(c, "docs", [1], [4], 5)) == ["2", "3"]
    assert keys(search.recommend(c, "docs", [[1.0, 0.0]], [], 2)) == ["1", "2"]
    assert keys(search.discover(c, "docs", [1, 2], 5)) == ["3", "4"]
    assert [tuple(r) for r in search.lookup(c, "docs", [3, 99, 1, 3]).collect()] == [(3, "3", 0.0), (1, "1", -2.0)]
    for bad in (lambda: search.recommend(c, "docs", [], [], 5), lambda: search.discover(c, "docs", [], 5), lambda: search.recommend(c, "docs", [0], [], 5), lambda: search.discover(c, "docs", [77], 5)):
        with pytest.raises(InvalidParameter):
            bad()


def branch(spark, rows, lower=False, weight=1.0):
    return fusion.Branch(spark.createDataFrame([(p, str(p), float(s)) for p, s in rows], "point_id long, source_key string, score double"), lower, weight)


def test_fusion_known_answers(spark):
    a, b = branch(spark, [(10, 3), (20, 2), (30, 1)]), branch(spark, [(30, 3), (10, 2), (40, 1)])
    got = {r["point_id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert got == pytest.approx({10: 1 / 61 + 1 / 62, 30: 1 / 63 + 1 / 61, 20: 1 / 62, 40: 1 / 63})
    dup = fusion.rrf([branch(spark, [(1, 3), (1, 2), (2, 1)])])
    assert {r["point_id"]: r["score"] for r in dup.collect()} == pytest.approx({1: 1 / 61, 2: 1 / 63})
    w = fusion.weighted([branch(spark, [(1, 0.1), (2, 0.9), (2, 0.8)], weight=3), branch(spark, [(1, 1.0), (3, 0.0)], True, 1)])
    assert [(r["point_id"], r["score"]) for r in search.top(w, 5, True).collect()] == [(2, 0.75), (3, 0.25), (1, 0.0)]
    flat = fusion.weighted([branch(spark, [(1, 5), (2, 5)]), branch(spark, [(1, 1e308), (2, -1e308)])])
    assert {r["point_id"]: r["score"] for r in flat.collect()} == {1: 1.0, 2: 0.5}
    for weights in ([0.0], [-1.0, 2.0], [float("nan")]):
        with pytest.raises(InvalidParameter):
            fusion.weighted([branch(spark, [(1, 1)], weight=x) for x in weights])


def test_weighted_fusion_by_query(spark, data):
    rows = lambda *r: spark.createDataFrame([(q, p, str(p), float(s)) for q, p, s in r], "q long, point_id long, source_key string, score double")
    parts = [fusion.Branch(rows((1, 1, 0.1), (1, 2, 0.9), (1, 2, 0.8), (2, 1, 500), (2, 2, 300)), False, 3.0), fusion.Branch(rows((1, 1, 1.0), (1, 3, 0.0), (3, 9, 1e308), (3, 8, -1e308)), True, 1.0)]
    got = {(r["q"], r["point_id"]): r["score"] for r in fusion.weighted(parts, ["q"]).collect()}
    assert got == pytest.approx({(1, 1): 0.0, (1, 2): 0.75, (1, 3): 0.25, (2, 1): 0.75, (2, 2): 0.0, (3, 9): 0.0, (3, 8): 0.25})
    import __spark_entry__ as entry

    fused = entry.queries()["branch_fusion_all"](spark, data)
    rows = spark.read.parquet(f"{data}/search_candidates.parquet").where("query_id IS NOT NULL AND point_id IS NOT NULL AND NOT isnan(score) AND abs(score) < double('inf')")
    assert {tuple(r) for r in fused.select("query_id", "point_id").collect()} == {tuple(r) for r in rows.select("query_id", "point_id").distinct().collect()}


@pytest.fixture(scope="module")
def hybrid(spark):
    rows = [(10, [1.0, 0.0], "database internals"), (20, [0.0, 0.0], "database database"), (30, [2.0, 0.0], "storage database"), (40, [3.0, 0.0], "unrelated"), (50, None, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, body string").withColumn("terms", sparse.from_vector(F.coalesce("embedding", F.array(F.lit(0.0), F.lit(0.0)))))
    c = Catalog(spark)
    c.register_table("docs", df)
    c.create_collection("docs", "docs")
    c.register_vector("docs", "dense", "embedding", 2, "l2")
    c.register_sparse_vector("docs", "terms", "terms", 2, "inner_product")
    c.backfill_points("docs")
    return c


def test_hybrid_queries(hybrid):
    assert keys(query.hybrid_text(hybrid, "docs", [0.0, 0.0], "database", "body", 4)) == ["20", "10", "30", "40"]
    assert keys(search.search_full_text(hybrid, "docs", "Database", "body", 10)) == ["20", "10", "30"]
    assert keys(search.search_full_text(hybrid, "docs", "database storage", "body", 10)) == ["30"]
    assert keys(search.search_sparse(hybrid, "docs", "terms", "{1:1}/2", 2)) == ["40", "30"]
    assert keys(query.hybrid_sparse(hybrid, "docs", [0.0, 0.0], "terms", "{1:1}/2", 2)) == ["20", "40"]
    assert query.explain_hybrid(hybrid, "docs", "body").count() == 3
    assert query.explain_sparse(hybrid, "docs", "terms", "{1:1}/2", 2).first()["active_points"] == 5


def test_plans(hybrid):
    near = query.nearest([0.0, 0.0], 4)
    run = lambda p: [(r["source_key"], round(r["score"], 6)) for r in query.execute(hybrid, "docs", json.dumps(p)).collect()]
    assert run(near) == [("20", 0.0), ("10", 1.0), ("30", 2.0), ("40", 3.0)]
    assert run(query.score_threshold(near, 1.0, 2.0)) == [("10", 1.0), ("30", 2.0)]
    assert run(query.rerank(near, 2)) == [("20", 0.0), ("10", 1.0)]
    assert run(query.formula(near, "$score * 2 - -1")) == [("40", 7.0), ("30", 5.0), ("10", 3.0), ("20", 1.0)]
    assert run(query.lookup([3, 1])) == [("30", 0.0), ("10", -1.0)]
    assert run(query.prefetch([query.weight(near, 1.0), query.full_text("database", "body", 4)]))[0] == ("20", 1.0)
    assert run(query.prefetch([near, near]))[0] == ("20", round(2 / 61, 6))
    assert run(query.nearest([0.0, 0.0], 4, "dense", None)) == run(near)
    assert run(query.recommend([1], [], 1))[0][0] == "20" and run(query.discover([2], 1))[0][0] == "40"
    assert [r["stage"] for r in query.explain(hybrid, "docs", query.prefetch([near])).collect()] == ["nearest", "prefetch"]
    with pytest.raises(PySparkException, match="division"):
        run(query.formula(near, "1 / score"))


@pytest.mark.parametrize(
    "bad",
    [
        "x", [], {}, {"kind": "what"}, {"kind": "nearest", "vector": [1.0]}, {"kind": "nearest", "vector": [1.0], "limit": 0}, {"kind": "nearest", "vector": [1.0], "limit": 1, "z": 1},
        {"kind": "prefetch", "branches": []}, {"kind": "lookup", "point_ids": [0]}, {"kind": "recommend", "positive_point_ids": [], "negative_point_ids": [], "limit": 1},
        {"kind": "weight", "weight": -1, "branch": {"kind": "lookup", "point_ids": [1]}}, {"kind": "score_threshold", "min_score": 2, "max_score": 1, "branch": {"kind": "lookup", "point_ids": [1]}},
        {"kind": "formula", "formula": "score +", "branch": {"kind": "lookup", "point_ids": [1]}}, {"kind": "full_text", "text_query": "", "text_column": "b", "limit": 1},
    ],
)
def test_plan_errors(bad):
    with pytest.raises((InvalidParameter, ValueError)):
        query.parse(bad)


def test_plan_and_formula_budgets():
    deep = {"kind": "lookup", "point_ids": [1]}
    for _ in range(32):
        deep = query.weight(deep, 1.0)
    with pytest.raises(BudgetExceeded):
        query.parse(deep)
    for bad in ("", "1 2", "(1", "a", "1 +* 2", "1" * 600):
        with pytest.raises(InvalidParameter):
            Formula(bad)
    with pytest.raises(InvalidParameter):
        Formula("+".join(["1"] * 200))
    with pytest.raises(BudgetExceeded):
        Formula("+".join(["1"] * 100)).check(1000)


def test_late_interaction(spark, tmp_path):
    rows = [(10, [[1.0, 0.0], [0.0, 1.0]]), (20, [[0.8, 0.1], [0.1, 0.7]]), (30, [[1.0, 0.0], [1.0, 0.0]]), (40, [[0.0, 0.0]])]
    c = make(spark, rows, "id int, tokens array<array<double>>", None)
    q = [[1.0, 0.0], [0.0, 1.0]]
    want = [("10", 2.0), ("20", 1.5), ("30", 1.0), ("40", 0.0)]
    assert [(r["source_key"], round(r["score"], 9)) for r in search.search_late_interaction(c, "docs", q, "tokens", 10).collect()] == want
    r = register_late_interaction(c, "docs", "tokens", str(tmp_path / "tokens")).first()
    assert (r["dimensions"], r["point_count"], r["token_count"], r["status"]) == (2, 4, 7, "ready")
    assert repair_late_interaction(c, "docs", str(tmp_path / "tokens")).first()["token_count"] == 7
    got = query.execute(c, "docs", query.late_interaction(q, 5, 3)).collect()
    assert [(r["source_key"], round(r["score"], 9)) for r in got] == want[:3]
    assert query.explain_late_interaction(c, "docs", q, "tokens", 5).count() == 2
    for bad in ([], [[1.0], [1.0, 2.0]]):
        with pytest.raises(InvalidParameter):
            late.check_queries(bad)
    got = late.rerank(spark, [[1.0, 0.0]], [7, 8], [[1.0, 0.0], [0.5, 0.0], [3.0, 0.0]], [0, 2, 3], 2).collect()
    assert [tuple(r) for r in got] == [(8, 3.0), (7, 1.0)]
    for offsets in ([0, 3], [1, 2, 3], [0, 2, 2], [0, 0, 3]):
        with pytest.raises(InvalidParameter):
            late.check_offsets(offsets, 3, 2)
    empty = make(spark, [(1, [])], "id int, tokens array<array<double>>", None)
    with pytest.raises(PySparkException, match="22023"):
        search.search_late_interaction(empty, "docs", q, "tokens", 1).collect()


def test_payload(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("status", T.StringType()), T.StructField("n", T.IntegerType(), False), T.StructField("metadata", T.StringType()), T.StructField("at", T.TimestampType())])
    c = Catalog(spark)
    c.register_table("t", spark.createDataFrame([(1, "open", 1, '{"topic": "a", "l": [1]}', datetime.datetime(2024, 1, 1)), (2, "open", 2, None, None)], schema))
    c.create_collection("t", "t")
    for k in ("status", "n", "at"):
        c.register_filter_column("t", k, k)
    c.register_json_path("t", "topic", "metadata", ["topic"])
    c.register_json_path("t", "deep", "metadata", ["x", "y"])
    c.backfill_points("t")
    changed, report = mutations.set_payload(c, "t", ["1"], {"status": "done", "topic": "b", "deep": 3})
    rows = {r["id"]: r for r in changed.collect()}
    assert rows[1]["status"] == "done" and json.loads(rows[1]["metadata"]) == {"topic": "b", "l": [1], "x": {"y": 3}} and rows[2]["status"] == "open"
    assert [tuple(r) for r in report.collect()] == [("1", True)]
    changed, _ = mutations.set_payload(c, "t", ["2"], {"topic": "z"})
    assert json.loads(changed.where("id = 2").first()["metadata"]) == {"topic": "z"}
    changed, _ = mutations.delete_payload(c, "t", ["1"], ["status", "topic"])
    r = changed.where("id = 1").first()
    assert r["status"] is None and json.loads(r["metadata"]) == {"l": [1]}
    for bad, e in ((lambda: mutations.set_payload(c, "t", ["1"], {"nope": 1}), InvalidParameter), (lambda: mutations.set_payload(c, "t", ["9"], {"status": "x"}), UnknownPoint), (lambda: mutations.delete_payload(c, "t", ["1"], ["n"]), InvalidParameter), (lambda: mutations.set_payload(c, "t", ["1"], {"at": 1}), WrongColumnType), (lambda: mutations.clear_payload(c, "t", ["1"]), InvalidParameter)):
        with pytest.raises(e):
            bad()


def test_reports(spark, basic, tmp_path):
    assert tuple(operations.recall_check(spark, [1, 2, 2], [2, 3], 0.5).first()) == (2, 2, 1, 0.5, "passing")
    assert operations.recall_check(spark, [], [1], 0.9).first()["status"] == "empty_exact"
    path = str(tmp_path / "stats")
    for ms in (0.5, 50.0, None):
        operations.record_query_stat(spark, path, "docs", "a", "nearest", 10, 100, ms)
    with pytest.raises(InvalidParameter):
        operations.record_query_stat(spark, path, "docs", "a", "nearest", -1, 100)
    stats = spark.read.parquet(path)
    assert operations.query_cohort_stats(stats).first()["query_count"] == 3
    assert {r["latency_bucket"] for r in operations.query_execution_stats(stats).collect()} == {"lt_1ms", "lt_100ms", "unspecified"}
    assert operations.telemetry(basic).first()["status"] == "active"
    assert operations.optimization_status(basic, "docs").first()["status"] == "exact_only"
    assert {r["recommendation"] for r in operations.index_advisor(basic, "docs").collect()} == {"cluster_files", "extract_column", "build_index"}
    exact = lambda q: search.search(basic, "docs", q, 10)
    assert operations.compare_indexes(spark, {"exact": exact}, exact, [[0.0, 0.0]]).first()["recall_at_10"] == 1.0


def test_faults_count_only_for_active_points(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0], "a"), (3, [0.0, 0.0], "b"), (4, None, "b")]
    c = make(spark, rows, "id int, embedding array<float>, k string", metric="cosine")
    c.register_filter_column("docs", "k", "k")
    with pytest.raises(PySparkException, match="22023|22P02"):
        search.search(c, "docs", [1.0, 0.0], 5).collect()
    c.delete_points("docs", ["2"])
    with pytest.raises(PySparkException, match="22P02"):
        search.search(c, "docs", [1.0, 0.0], 5).collect()
    assert keys(search.search(c, "docs", [1.0, 0.0], 5, filter={"must": [{"key": "k", "match": "a"}]})) == ["1"]
    c.delete_points("docs", ["3"])
    assert keys(search.search(c, "docs", [1.0, 0.0], 5)) == ["1"]
    with pytest.raises(InvalidParameter):
        search.search(c, "docs", [0.0, 0.0], 5)


def test_vectors_are_not_shuffled(spark, tmp_path):
    spark.range(50).selectExpr("id", "array(float(id), float(1)) AS embedding", "'x' AS k").write.parquet(str(tmp_path / "t"))
    c = Catalog(spark)
    c.register_table("t", spark.read.parquet(str(tmp_path / "t")))
    c.create_collection("t", "t")
    c.register_vector("t", "dense", "embedding", 2, "l2")
    c.register_filter_column("t", "k", "k")
    c.backfill_points("t")
    plan = search.search(c, "t", [0.0, 0.0], 3, filter={"must": [{"key": "k", "match": "x"}]})._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "embedding" not in plan[:join] and "embedding" in plan[join:] and "(k#" in plan[join:]
