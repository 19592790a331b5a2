"""Scores and aggregates at any dimension run as generated code: with the fallback off, code that outgrows it is an error."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vantor.functions import scoring
from vantor.operators import late, search
from vantor.operators.aggregates import aggregate_vectors
from vantor.sources.catalog import Catalog


@pytest.fixture
def strict(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    yield spark
    spark.conf.set("spark.sql.codegen.fallback", "true")


def _distance(metric, a, b):
    dot = sum(x * y for x, y in zip(a, b))
    if metric == "inner_product":
        return -dot
    if metric == "cosine":
        return 1 - dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) if metric == "l2" else sum(abs(x - y) for x, y in zip(a, b))


@pytest.mark.parametrize("dims", [64, 128, 384])
def test_search_and_aggregates_compile(strict, dims):
    r = random.Random(dims)
    rows = [(i, i % 3, [float(round(r.uniform(-1, 1), 3)) for _ in range(dims)]) for i in range(1, 61)]
    df = strict.createDataFrame(rows, "id bigint, label int, v array<double>").cache()
    query = [round(r.uniform(-1, 1), 3) for _ in range(dims)]
    for metric in ("l2", "inner_product", "cosine", "l1"):
        c = Catalog(strict)
        c.register_table("t", df)
        c.create_collection("t", "t")
        c.register_vector("t", "d", "v", dims, metric)
        c.register_filter_column("t", "label", "label")
        c.adopt_points("t", df.select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
        got = search.search(c, "t", query, 5, filter={"must": [{"key": "label", "match": 1}]}).collect()
        want = sorted((_distance(metric, v, query), i) for i, label, v in rows if label == 1)[:5]
        assert [g.point_id for g in got] == [i for _, i in want]
        assert all(abs(g.score - s) < 1e-9 for g, (s, _) in zip(got, want))
    found = {r.label: r.value for r in aggregate_vectors(df, ["label"], "v", "avg", dims).collect()}
    for label in range(3):
        own = [v for _, x, v in rows if x == label]
        assert all(abs(a - sum(c) / len(own)) < 1e-9 for a, c in zip(found[label], zip(*own)))


def test_scores_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0])], "id int, v array<double>")
    cosine = {r.id: r.s for r in df.select("id", scoring.score("cosine", F.col("v"), [3.0, 4.0]).alias("s")).collect()}
    assert cosine[1] == pytest.approx(0) and cosine[2] is None and cosine[3] == scoring.NO_DIRECTION and cosine[4] is None and cosine[5] is None and math.isnan(cosine[6])
    assert df.limit(0).select(scoring.score("l2", F.col("v"), [1.0, 2.0])).count() == 0


def test_equal_vectors_have_equal_scores(spark):
    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(37)] for _ in range(7)]
    df = spark.createDataFrame([(i, i % 7, base[i % 7]) for i in range(700)], "id int, of int, v array<double>")
    for metric in ("l2", "inner_product", "cosine", "l1"):
        out = df.select("of", scoring.score(metric, F.col("v"), base[3]).alias("s")).groupBy("of").agg(F.countDistinct("s").alias("n")).collect()
        assert all(x.n == 1 for x in out)


def test_aggregate_keys_and_nulls(spark):
    df = spark.createDataFrame([(None, "a", [1.0, 2.0]), (None, "a", [3.0, None]), (1, "b", None), (1, None, [5.0, 5.0])], "k int, g string, v array<double>")
    out = {(r.k, r.g): (r.value, r.n) for r in aggregate_vectors(df, ["k", "g"], "v", "sum", 2, counted="n").collect()}
    assert out == {(None, "a"): ([4.0, 2.0], 2), (1, "b"): (None, 0), (1, None): ([5.0, 5.0], 1)}
    assert aggregate_vectors(df.limit(0), [], "v", "sum", 2).collect()[0].value is None
    with pytest.raises(Exception, match="22023"):
        aggregate_vectors(df, [], "v", "sum", 3).collect()


def test_tokens_that_are_odd(spark):
    df = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.5, 0.5]])], "id int, t array<array<double>>")
    got = {r.id: r.s for r in df.select("id", late.max_sim(F.col("t"), [[1.0, 0.0], [0.0, 2.0]]).alias("s")).collect()}
    assert got == {1: 3.0, 2: 1.5}
    with pytest.raises(Exception, match="22023"):
        df.select(late.max_sim(F.array().cast("array<array<double>>"), [[1.0, 0.0]])).collect()
