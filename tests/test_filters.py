import pytest
from pyspark.sql import functions as F

from vantor.errors import InvalidFilter, UnknownPayloadField
from vantor.plans.filters import Compiler, Field, parse

ROWS = [
    (1, "open", 5, True, '{"a": "5", "n": 5, "e": "", "x": null, "deep": {"k": [1, 2]}}'),
    (2, "closed", None, False, '{"a": 5, "n": 7.5, "e": "z"}'),
    (3, None, 9, None, None),
    (4, "", 1, True, "not json"),
]


@pytest.fixture(scope="module")
def ids(spark):
    df = spark.createDataFrame(ROWS, "id int, status string, n int, flag boolean, meta string")
    fields = {"status": Field("status"), "n": Field("n"), "flag": Field("flag"), "a": Field("meta", ("a",)), "mn": Field("meta", ("n",)), "e": Field("meta", ("e",)), "x": Field("meta", ("x",)), "k1": Field("meta", ("deep", "k", "1")), "gone": Field("meta2")}
    c = Compiler(fields, df.schema)
    return lambda f: [r[0] for r in df.where(c.compile(f)).orderBy("id").select("id").collect()]


def must(*conditions):
    return {"must": list(conditions)}


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ({"key": "status", "match": "open"}, [1]),
        ({"key": "status", "match": {"value": "closed"}}, [2]),
        ({"key": "status", "match": {"any": ["open", ""]}}, [1, 4]),
        ({"key": "status", "match": {"except": ["open"]}}, [2, 4]),
        ({"key": "status", "is_null": True}, [3]),
        ({"key": "status", "is_null": False}, [1, 2, 4]),
        ({"key": "status", "is_empty": True}, [4]),
        ({"key": "status", "is_empty": False}, [1, 2]),
        ({"key": "n", "range": {"gt": 1, "lte": 9}}, [1, 3]),
        ({"key": "flag", "match": False}, [2]),
        ({"key": "a", "match": "5"}, [1]),
        ({"key": "a", "match": 5}, [2]),
        ({"key": "a", "match": {"any": ["5", 5]}}, [1, 2]),
        ({"key": "a", "match": {"except": [5]}}, [1]),
        ({"key": "mn", "range": {"gte": 6}}, [2]),
        ({"key": "a", "range": {"gte": 1}}, [2]),
        ({"key": "e", "is_empty": True}, [1]),
        ({"key": "e", "is_empty": False}, [2]),
        ({"key": "x", "is_null": False}, [1]),
        ({"key": "x", "match": None}, [1]),
        ({"key": "x", "is_null": True}, [2, 3, 4]),
        ({"key": "k1", "match": 2}, [1]),
        # of several predicates the last by name holds
        ({"key": "n", "match": 5, "range": {"gte": 9}}, [3]),
    ],
)
def test_predicates(ids, condition, want):
    assert ids(must(condition)) == want


def test_groups_and_three_valued_logic(ids):
    assert ids({"must_not": [{"key": "status", "match": "open"}]}) == [2, 4]
    assert ids({"should": [{"key": "n", "match": 5}, {"key": "n", "match": 9}], "must": [{"must_not": [{"key": "status", "match": "x"}]}]}) == [1]
    assert ids('{"should": [{"key": "n", "match": 1}]}') == [4]


@pytest.mark.parametrize(
    "bad",
    [
        {}, [], "nonsense", {"must": []}, {"any": []}, must({}), must({"key": "n"}), must({"key": "n", "like": 1}), must({"key": "n", "match": None}), must({"key": "n", "match": {"any": []}}),
        must({"key": "n", "range": {}}), must({"key": "n", "range": {"gt": True}}), must({"key": "n", "is_null": 1}), must({"key": "n", "match": "5"}), must({"key": "status", "match": 5}),
        must({"key": "n..x", "match": 5}), must({"key": "status", "match": {"any": ["a", 1]}}), must({"key": "n", "is_empty": True}),
    ],
)
def test_errors(ids, bad):
    with pytest.raises(InvalidFilter):
        ids(bad)


def test_unknown_fields_and_budgets(ids):
    for key in ("nope", "gone"):
        with pytest.raises(UnknownPayloadField):
            ids(must({"key": key, "match": 1}))
    deep = {"key": "n", "match": 1}
    for _ in range(15):
        deep = must(deep)
    parse(deep)
    with pytest.raises(InvalidFilter):
        parse(must(must(deep)))
    with pytest.raises(InvalidFilter):
        parse(must(*[{"key": "n", "match": 1}] * 257))


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = df.where(Compiler({"n": Field("n")}, df.schema).compile(must({"key": "n", "range": {"gte": 5}})))
    assert "GreaterThanOrEqual(n,5)" in rows._jdf.queryExecution().toString()
    assert rows.agg(F.count("*")).first()[0] == 28
