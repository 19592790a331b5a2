"""Indexes that searches use: attached lists and graphs, stored codes, postings of sparse vectors, tokens; and what is kept of builds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, NotReady, UnsupportedMetric
from vantor.operators import ann, fusion, graph, postings, search
from vantor.plans import query
from vantor.sources.catalog import Catalog
from vantor.sources.jobs import Artifacts, BuildJobs, encode_segment


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(6)
    x = g.normal(size=(400, 12)).astype(np.float32)
    x[300:] = x[0]  # a quarter of exact copies
    return x


@pytest.fixture(scope="module")
def docs(spark, vectors):
    return spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(vectors)], "id long, label int, v array<float>").cache()


def collection(spark, docs, metric="l2"):
    c = Catalog(spark)
    c.register_table("t", docs)
    c.create_collection("t", "t")
    c.register_vector("t", "d", "v", 12, metric)
    c.register_filter_column("t", "label", "label")
    c.adopt_points("t", docs.select((F.col("id") + 1000).alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    return c


@pytest.mark.parametrize("kind", ["graph", "lists"])
def test_attached_index(spark, docs, vectors, tmp_path, kind):
    c, q = collection(spark, docs), (vectors[7] + 0.01).tolist()
    with pytest.raises(NotReady):
        search.search(c, "t", q, 5, strategy="index")
    search.build_index(c, "t", f"file://{tmp_path}/{kind}", kind=kind)
    ids = lambda **k: [(r.point_id, r.source_key, round(r.score, 9)) for r in search.search(c, "t", q, 5, **k).collect()]
    near = {"probes": 100, "ef": 200}
    assert ids(strategy="index", **near) == ids(strategy="exact")
    f = {"must": [{"key": "label", "match": 3}]}
    assert ids(strategy="index", filter=f, **near) == ids(strategy="exact", filter=f)
    assert ids(strategy="index", candidates=[1007, 1009, 1350], **near) == ids(strategy="exact", candidates=[1007, 1009, 1350])
    c.delete_points("t", ["7"])  # still in the index
    assert ids(strategy="index", **near) == ids(strategy="exact") and ids(strategy="exact")[0][0] != 1007
    assert search.chosen_index(c, c.vector(c.exact("t"))) is None  # too small to be used unasked
    assert query.explain(c, "t", query.nearest(q, 5)).first()["strategy"] == "exact"
    c.attach_index("t", "d", f"file://{tmp_path}/nothing")
    assert ids() == ids(strategy="exact")
    with pytest.raises(InvalidParameter):
        search.search(c, "t", q, 5, strategy="fast")


def test_graph_with_copies(spark, docs, vectors, tmp_path):
    """Equal vectors share a node; all of them, and what lies beyond them, are found."""
    g = graph.GraphIndex.build(docs, "id", "v", 12, "l2", f"file://{tmp_path}/g", shard_rows=200)
    q = vectors[0].tolist()
    got = [r.point_id for r in g.search(q, 110).collect()]
    d = ((vectors - vectors[0]) ** 2).sum(1)
    want = np.lexsort((np.arange(400), np.round(d, 5)))[:110].tolist()
    assert got[:101] == want[:101] and len(set(got) & set(want)) >= 108
    masked = [r.point_id for r in g.search(q, 20, allowed=spark.range(310, 340)).collect()]
    assert masked == list(range(310, 330))
    g.remove(spark.range(310, 320))
    assert [r.point_id for r in g.search(q, 5, allowed=spark.range(310, 340)).collect()] == list(range(320, 325))
    assert g.status().first()["rows"] == 400
    many = g.search_many([q, vectors[9].tolist()], 3).collect()
    assert {(r.query, r.point_id) for r in many} >= {(0, 0), (1, 9)} and len(many) == 6


def test_stored_codes_and_empty_masks(spark, docs, vectors, tmp_path):
    index = ann.AnnIndex.build(docs, "id", "v", 12, "cosine", f"file://{tmp_path}/i", lists=10)
    queries = [vectors[i].tolist() for i in (5, 50)]
    exact = {(r.query, r.point_id) for r in index.search_many(queries, 5, 100).collect()}
    assert exact == {(r.query, r.point_id) for r in index.search_many(queries, 5, 100, None, "scalar", 40).collect()}
    assert len(exact & {(r.query, r.point_id) for r in index.search_many(queries, 5, 100, None, "binary", 150).collect()}) >= 8
    assert index.search_many(queries, 5, 100, spark.range(0)).collect() == []
    with pytest.raises(InvalidParameter):
        index.search_many(queries, 5, 3, None, "rough")


@pytest.mark.parametrize("metric", ["inner_product", "cosine", "l2"])
def test_postings_against_brute_force(spark, tmp_path, metric):
    r = random.Random(4)
    rows = [(i, sorted(r.sample(range(1, 31), r.randint(0, 8)))) for i in range(200)]
    rows = [(i, (30, t, [float(round(r.uniform(-1, 1), 2)) for _ in t])) for i, t in rows]
    df = spark.createDataFrame([*rows, (999, None)], "id long, s struct<dims:int,indices:array<int>,values:array<float>>")
    index = postings.SparseIndex.build(df, "id", "s", 30, metric, f"file://{tmp_path}/{metric}")
    index.remove(spark.range(0, 10))
    q = {3: 1.0, 7: -0.5, 11: 0.25, 20: 2.0}
    text = "{" + ",".join(f"{i}:{x}" for i, x in q.items()) + "}/30"

    def score(v):
        entries = {i: float(np.float32(x)) for i, x in zip(v[1], v[2])}
        ip = sum(x * entries.get(i, 0) for i, x in q.items())
        n = sum(x * x for x in entries.values())
        m = sum(x * x for x in q.values())
        return -ip if metric == "inner_product" else 1 - ip / math.sqrt(n * m) if metric == "cosine" else math.sqrt(max(0, n + m - 2 * ip))

    hit = [(round(score(v), 6), i) for i, v in rows if i >= 10 and set(v[1]) & set(q)]
    got = index.candidates(text, 15).collect()
    assert [round(x.score, 6) for x in got] == [s for s, _ in sorted(hit)[:15]]
    some = index.candidates(text, 100, allowed=spark.range(50, 90)).collect()
    assert {x.point_id for x in some} == {i for _, i in hit if 50 <= i < 90}
    with pytest.raises(UnsupportedMetric):
        postings.SparseIndex.build(df, "id", "s", 30, "l1", f"file://{tmp_path}/no")


def test_tokens_by_index(spark, tmp_path):
    g = np.random.default_rng(3)
    x = g.normal(size=(600, 8))
    tokens = spark.createDataFrame([(i, i % 150, v.tolist()) for i, v in enumerate(x)], "token_id long, point long, t array<float>")
    c = Catalog(spark)
    c.register_table("p", spark.range(150))
    c.create_collection("p", "p")
    c.adopt_points("p", spark.range(150).select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    queries = [x[3].tolist(), x[153].tolist()]
    ways = {"graph": graph.GraphIndex.build(tokens, "token_id", "t", 8, "inner_product", f"file://{tmp_path}/g"), "lists": ann.AnnIndex.build(tokens, "token_id", "t", 8, "inner_product", f"file://{tmp_path}/l", owner="point")}
    found = lambda **k: [(r.point_id, round(r.score, 6)) for r in search.search_late_interaction_tokens(c, "p", queries, tokens, "point", "t", 200, 5, **k).collect()]
    exact = found()
    best = (x @ np.array(queries).T).reshape(4, 150, 2).max(0).sum(1)  # token i belongs to point i % 150
    assert [p for p, _ in exact] == np.argsort(-best, kind="stable")[:5].tolist()
    assert found(index=ways["graph"], token="token_id") == exact and found(index=ways["lists"], probes=100) == exact
    stages = query.explain_late_interaction_ann(c, "p", queries, ways["lists"], 20, 2).collect()
    assert [s.stage for s in stages] == ["probe", "candidates", "score"] and 0 < stages[0].estimated_candidates < 600 and stages[0].status == "ready"


def test_builds_are_kept(spark, tmp_path):
    jobs = BuildJobs(spark, f"file://{tmp_path}/jobs")
    job = jobs.start("c", "vectors", "a", "t", 10)
    jobs.run(job.build_job_id, lambda a, b: None, 4)
    Artifacts(spark, f"file://{tmp_path}/a", jobs).publish(1, encode_segment("vectors", b"abc"))
    again = BuildJobs(spark, f"file://{tmp_path}/jobs")
    assert again.job(1).status == "completed" and again.listing().count() == 1
    kept = Artifacts(spark, f"file://{tmp_path}/a", again)
    assert kept.read(1) == ("vectors", b"abc") and kept.diagnostics().first()["status"] == "ready"
    kept.retire(1)
    kept.cleanup(dry_run=False)
    assert Artifacts(spark, f"file://{tmp_path}/a", again).listing().first()["lifecycle_state"] == "removed"


def test_fusion_takes_bounded_branches(spark, monkeypatch):
    monkeypatch.setattr(fusion, "MOST", 3)
    rows = spark.range(1, 11).select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.col("id").cast("double").alias("score"))
    assert {r.point_id for r in fusion.rrf([fusion.Branch(rows, True)]).collect()} == {1, 2, 3}
    assert {r.point_id for r in fusion.weighted([fusion.Branch(rows, False)]).collect()} == {8, 9, 10}
