"""Queries over collections: search, filters, facets, fusion, plans, mutations, reports and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.functions import sparse
from vantor.functions.vectors import l2_distance
from vantor.operators import ann, batch, fusion, graph, mutations, operations, postings, search, text
from vantor.plans import query
from vantor.plans.filters import Compiler, Field
from vantor.queries.vectors import CUT, l1, q_sql, query_vector, sparse_column, sparse_query
from vantor.runtime import drawn, finite, materialize, scratch, table
from vantor.sources.catalog import Catalog
from vantor.sources.jobs import Artifacts, BuildJobs, encode_segment
from vantor.sources.tokens import explode_tokens
from vantor.sources.versioned import VersionedTable

_METRICS = ("l2", "inner_product", "cosine", "l1")


def catalog(spark: SparkSession, d: str, *names: str, docs: bool = False, terms: bool = False) -> Catalog:
    """The named collections: over embeddings one per metric, "emb" being cosine, and events; every row has a point whose id is the row's.

    docs and terms say whether the rows have the fields of their documents and sparse vectors. Without names there is everything.
    """
    out = Catalog(spark)
    wanted, docs, terms = names or ("emb", *(f"emb_{m}" for m in _METRICS), "events"), docs or not names, terms or not names
    if wanted != ("events",):
        emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", F.format_string('{"label": %d, "half": "%d"}', "label", F.col("label") % 2).alias("metadata"))
        rows = emb.withColumn("terms", sparse_column(F.col("embedding"))) if terms else emb
        if docs:
            texts = table(spark, d, "documents").select(F.col("doc_id").alias("_doc"), F.lower("lang").alias("lang"), "tenant_id", "text")
            rows = rows.join(texts, F.col("id") == F.col("_doc"), "left").drop("_doc")
        out.register_table("embeddings", rows)
    for name in wanted:
        if name == "events":
            continue
        out.create_collection(name, "embeddings")
        out.register_vector(name, "dense", "embedding", 64, "cosine" if name == "emb" else name[4:])
        if terms:
            out.register_sparse_vector(name, "terms", "terms", 64, "inner_product")
        for key in ("label", "lang", "tenant_id", "text") if docs else ("label",):
            out.register_filter_column(name, key, key)
        out.register_json_path(name, "meta.label", "metadata", ["label"])
        out.register_json_path(name, "meta.half", "metadata", ["half"])
        out.adopt_points(name, emb.select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    if "emb" in wanted:
        out.create_alias("vectors", "emb")
    if "events" in wanted:
        events = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", "props", "ts", F.array(F.col("value").cast("float")).alias("v"))
        out.register_table("events", events)
        out.create_collection("events", "events")
        out.register_vector("events", "v", "v", 1, "l2")
        for key in ("user_id", "event_type", "value", "ts"):
            out.register_filter_column("events", key, key)
        out.register_json_path("events", "k", "props", ["k"])
        out.adopt_points("events", events.select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    return out


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _search(metric: str):
    return lambda spark, d: _rounded(search.search(catalog(spark, d, f"emb_{metric}"), f"emb_{metric}", query_vector(spark, d), 10))


def _search_alias(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(catalog(spark, d, "emb"), "vectors", query_vector(spark, d, 3), 25, name="dense"))


FILTER = {"must": [{"key": "label", "match": {"any": [1, 3, 5, 7]}}], "must_not": [{"key": "lang", "match": "de"}]}


def _search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(catalog(spark, d, "emb", docs=True), "emb", query_vector(spark, d), 20, filter=FILTER))


def _search_json(spark: SparkSession, d: str) -> DataFrame:
    f = {"must": [{"key": "meta.label", "range": {"gte": 2, "lt": 6}}], "should": [{"key": "meta.half", "match": "1"}, {"key": "meta.half", "match": 0}]}
    return _rounded(search.search(catalog(spark, d, "emb"), "emb", query_vector(spark, d), 20, filter=f))


def _search_candidates(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(0, 400, 7)
    return _rounded(search.search(catalog(spark, d, "emb"), "emb", query_vector(spark, d), 15, candidates=ids, filter={"must": [{"key": "label", "range": {"gte": 1}}]}))


def _search_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search_sparse(catalog(spark, d, "emb", terms=True), "emb", "terms", sparse_query(spark, d), 12, {"must": [{"key": "label", "is_null": False}]}))


def _search_inline(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of some rows' vectors, given as constants."""
    rows = table(spark, d, "embeddings").where(F.col("vec_id") < 20).select("vec_id", "embedding").collect()
    return _rounded(search.inline(spark, query_vector(spark, d, 30), [r[0] for r in rows], [r[1] for r in rows], "cosine", 5))


def _search_inline_sparse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(F.col("vec_id") < 20).select("vec_id", "embedding").collect()
    cut = [[x if abs(x) >= CUT else 0.0 for x in r[1]] for r in rows]
    return _rounded(search.inline_sparse(spark, sparse_query(spark, d, 30), [r[0] for r in rows], [sparse.literal(v) for v in cut], "inner_product", 5))


def _search_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Nearest points between two scores."""
    plan = query.score_threshold(query.nearest(query_vector(spark, d), 60), 0.5, 0.8)
    return _rounded(query.execute(catalog(spark, d, "emb"), "emb", plan))


NESTED = {
    "must": [{"key": "label", "range": {"gte": 1}, "match": {"any": [2, 3, 4, 6, 8]}}, {"should": [{"key": "lang", "match": "en"}, {"must": [{"key": "label", "match": 4}], "must_not": [{"key": "lang", "is_null": True}]}]}],
}


def _count_nested(spark: SparkSession, d: str) -> DataFrame:
    """Filters within filters, and several predicates in one condition, of which the last by name holds."""
    return search.count(catalog(spark, d, "emb", docs=True), "emb", NESTED)


def _plan_of(node) -> object:
    return lambda spark, d: _rounded(query.execute(catalog(spark, d, "emb_l2"), "emb_l2", node))


def _token_catalog(spark: SparkSession, d: str) -> Catalog:
    """The embeddings as four tokens of 16 values each, registered for late interaction."""
    out = Catalog(spark)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", tokens.alias("tokens"))
    out.register_table("tokens", rows)
    out.create_collection("tokens", "tokens")
    out.register_vector("tokens", "dense", "embedding", 64, "cosine")
    out.adopt_points("tokens", rows.select(F.col("id").alias("point_id"), F.col("id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    out.exact("tokens").tokens = ("tokens", "tokens")
    return out


def _late_queries(spark: SparkSession, d: str) -> list[list[float]]:
    q = query_vector(spark, d)
    return [q[:16], q[16:32]]


def _plan_late(spark: SparkSession, d: str) -> DataFrame:
    """A plan's late interaction: tokens choose points, whose whole scores order them; as many candidates as the scores of the first ten need."""
    return _rounded(query.execute(_token_catalog(spark, d), "tokens", query.late_interaction(_late_queries(spark, d), 2000, 10)))


def _search_late(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search_late_interaction(_token_catalog(spark, d), "tokens", _late_queries(spark, d), "tokens", 10))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.grouped_search(catalog(spark, d, "emb"), "emb", query_vector(spark, d), "label", 3, 30))


def _count(spark: SparkSession, d: str) -> DataFrame:
    return search.count(catalog(spark, d, "events"), "events", {"must": [{"key": "event_type", "match": {"except": ["click"]}}, {"key": "ts", "range": {"gte": "2024-01-15 00:00:00"}}], "must_not": [{"key": "value", "range": {"lt": 10}}]})


def _count_json(spark: SparkSession, d: str) -> DataFrame:
    return search.count(catalog(spark, d, "events"), "events", {"must": [{"key": "k", "range": {"gte": 20, "lte": 60}}, {"key": "k", "match": {"except": [33, 44]}}]})


def _facet(spark: SparkSession, d: str) -> DataFrame:
    return search.facet(catalog(spark, d, "events"), "events", "event_type", {"must": [{"key": "value", "range": {"gt": 1}}]}, 10)


def _facet_json(spark: SparkSession, d: str) -> DataFrame:
    return search.facet(catalog(spark, d, "events"), "events", "k", None, 25)


def _scroll(spark: SparkSession, d: str) -> DataFrame:
    """Two pages, the second from the cursor of the last row of the first."""
    c = catalog(spark, d, "emb")
    first = search.scroll(c, "emb", None, 50)
    after = first.orderBy(F.desc("point_id")).first()["next_cursor"]
    second = search.scroll(c, "emb", after, 50)
    return first.unionByName(second).select("point_id", "source_key")


def _recommend(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.recommend(catalog(spark, d, "emb_l2"), "emb_l2", [1, 2, 3], [4, 5], 10))


def _discover(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.discover(catalog(spark, d, "emb_l2"), "emb_l2", [7, 8], 10))


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.lookup(catalog(spark, d, "emb"), "emb", [42, 7, 99_999_999, 13])


TERM = "the"


def _full_text(spark: SparkSession, d: str) -> DataFrame:
    """All documents that hold a term, by its number of occurrences."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text").where(text.matches(F.col("text"), TERM))
    return search.top(rows.select("point_id", F.round(text.rank(F.col("text"), TERM), 6).alias("score")), 50, descending=True, keep=("point_id", "score"))


def _full_text_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all of three terms."""
    return table(spark, d, "documents").where(text.matches(F.col("text"), "the query is")).select("doc_id")


def _hybrid_text(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(query.hybrid_text(catalog(spark, d, "emb", docs=True), "emb", query_vector(spark, d), TERM, "text", 10))


def _hybrid_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(query.hybrid_sparse(catalog(spark, d, "emb", terms=True), "emb", query_vector(spark, d), "terms", sparse_query(spark, d), 10))


def _plan_weighted(spark: SparkSession, d: str) -> DataFrame:
    plan = query.prefetch([query.weight(query.nearest(query_vector(spark, d), 20), 3.0), query.nearest(query_vector(spark, d, 1), 20)])
    return _rounded(query.execute(catalog(spark, d, "emb"), "emb", plan))


def _plan_formula(spark: SparkSession, d: str) -> DataFrame:
    plan = query.rerank(query.formula(query.score_threshold(query.nearest(query_vector(spark, d), 40), 0.1, None), "(1 - $score) * 2 + -0.5 / 4"), 12)
    return _rounded(query.execute(catalog(spark, d, "emb"), "emb", plan))


def _plan_explain(spark: SparkSession, d: str) -> DataFrame:
    plan = query.prefetch([query.nearest(query_vector(spark, d), 20), query.full_text(TERM, "text", 20)])
    return query.explain(catalog(spark, d, "emb"), "emb", plan).select("stage", "branch", "strategy", "estimated_candidates", "candidate_budget")


def _branch_fusion_all(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of all branches of every query's candidates, dense_exact counting twice."""
    name = lambda c: F.lower(F.translate(c, "_-", ""))
    rows = table(spark, d, "search_candidates").where(finite(F.col("score")) & F.col("query_id").isNotNull() & F.col("point_id").isNotNull())
    rows = rows.select("query_id", "point_id", F.col("point_id").cast("string").alias("source_key"), name("branch").alias("branch"), "score")
    known = table(spark, d, "search_branches").select(name("branch").alias("branch"), F.lower("score_order").alias("way")).distinct().orderBy("branch").collect()  # six rows
    parts = [fusion.Branch(rows.where(F.col("branch") == b).drop("branch"), way == "lowerisbetter", 2.0 if b == "denseexact" else 1.0) for b, way in known]
    return fusion.weighted(parts, ["query_id"]).select("query_id", "point_id", F.round("score", 6).alias("score"))


def _visible_points(spark: SparkSession, d: str) -> DataFrame:
    """The present version of each point that isn't deleted and has a source row."""
    versions = table(spark, d, "collection_points")
    newest = versions.groupBy("point_id", "collection_id").agg(F.max(F.struct(F.greatest("created_at", "updated_at", "deleted_at").alias("t"), F.col("deleted_at").isNull().alias("live"), "source_key")).alias("v"))
    docs = table(spark, d, "source_docs").select(F.col("id").cast("string").alias("source_key")).distinct()
    live = newest.where("v.live").select("point_id", "collection_id", F.col("v.source_key").alias("source_key"))
    return live.join(docs, "source_key", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_points"))


def _filter_docs(spark: SparkSession, d: str) -> DataFrame:
    """JSON-path and column predicates over all source documents, nulls and incomplete metadata included."""
    docs = table(spark, d, "source_docs")
    c = Compiler({"status": Field("status"), "lang": Field("metadata", ("language",)), "rev": Field("metadata", ("rev",)), "topic": Field("metadata", ("topic",))}, docs.schema)
    f = {"must": [{"key": "rev", "range": {"gte": 10}}, {"key": "topic", "is_empty": False}], "must_not": [{"key": "lang", "match": "en"}]}
    return docs.where(c.compile(f)).select("id").distinct()


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points for all customers in batches, after a third of them were there and some of those deleted."""
    c = Catalog(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    c.register_table("customer", rows)
    c.create_collection("customers", "customer")
    c.upsert_points("customers", rows.where(F.col("id") % 3 == 0).select("id"))
    c.delete_points("customers", rows.where(F.col("id") % 6 == 0).select("id"))
    return c.backfill_points("customers", 100)


def _point_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that points get: in the order of their keys."""
    c = Catalog(spark)
    c.create_collection("suppliers")
    return c.upsert_points("suppliers", table(spark, d, "supplier").select(F.col("s_suppkey").cast("string"))).select("point_id", "source_key", "inserted")


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """Columns and JSON paths changed in some rows."""
    c = catalog(spark, d, "emb")
    changed, _ = mutations.set_payload(c, "emb", [str(i) for i in range(0, 40, 4)], {"label": 77, "meta.half": "x"})
    return changed.select(F.col("id").alias("vec_id"), "label", F.get_json_object("metadata", "$.half").alias("half"), F.get_json_object("metadata", "$.label").alias("meta_label"))


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    return operations.telemetry(catalog(spark, d)).select("collection_name", "registered_vectors", "active_points", "deleted_points", "status")


def _stats_source(spark: SparkSession, d: str) -> DataFrame:
    """Statistics rows made of events: value as the latency."""
    e = table(spark, d, "events")
    return e.select(
        F.lit("events").alias("collection_name"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("cohort"), F.col("event_type").alias("query_kind"), F.lit("exact").alias("strategy"),
        F.col("event_id").alias("result_count"), F.lit(1).alias("visits"), F.lit(2).alias("filter_candidates"), F.col("event_id").alias("candidates_considered"), F.lit(3).alias("rows_rechecked"),
        F.lit(4).alias("rows_pruned"), F.lit(1.0).alias("recall_achieved"), F.col("value").alias("latency_ms"),
    )


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    rows = operations.query_cohort_stats(_stats_source(spark, d))
    return rows.select("cohort", "query_kind", "query_count", "total_results", "total_rows_rechecked", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


def _executions(spark: SparkSession, d: str) -> DataFrame:
    rows = operations.query_execution_stats(_stats_source(spark, d))
    return rows.select("query_kind", "latency_bucket", "query_count", "total_candidates", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    """Per query of hydrated_candidates: recall of the points above one half within those above one quarter."""
    rows = table(spark, d, "hydrated_candidates").where(~F.isnan("score"))
    out = operations.recall_by_query(rows.where(F.col("score") > 0.25).select("query_id", "point_id"), rows.where(F.col("score") > 0.5).select("query_id", "point_id"), "query_id", "point_id")
    return out.withColumn("recall", F.round("recall", 6))


def _index(spark: SparkSession, d: str) -> ann.AnnIndex:
    path = scratch(spark, "index")
    return ann.AnnIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", 64, "cosine", path)


def _index_all(spark: SparkSession, d: str) -> DataFrame:
    """All lists probed, after points were removed, others added again and the index compacted: the exact result."""
    rows, index = table(spark, d, "embeddings"), _index(spark, d)
    index.remove(rows.where(F.col("vec_id") % 5 == 0).select("vec_id"))
    index.add(rows.where(F.col("vec_id") % 10 == 0), "vec_id", "embedding")
    index.compact()
    return _rounded(index.search(query_vector(spark, d), 20, probes=10_000))


def _index_masked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(F.col("label") == 3).select("vec_id")
    return _rounded(_index(spark, d).search(query_vector(spark, d), 10, probes=10_000, allowed=rows))


def _index_quantized(spark: SparkSession, d: str) -> DataFrame:
    """Scalar codes choose 100 points, the exact distance orders them."""
    return _rounded(_index(spark, d).search_quantized(query_vector(spark, d), 10, 100, probes=10_000))


def _graph(spark: SparkSession, d: str) -> graph.GraphIndex:
    path = scratch(spark, "graph")
    return graph.GraphIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", 64, "cosine", path, shard_rows=500)


def _graph_search(spark: SparkSession, d: str) -> DataFrame:
    """A beam as wide as a shard finds the exact result."""
    return _rounded(_graph(spark, d).search(query_vector(spark, d), 10, ef=500))


def _graph_masked(spark: SparkSession, d: str) -> DataFrame:
    """Only points of some labels, after some were removed."""
    rows, index = table(spark, d, "embeddings"), _graph(spark, d)
    index.remove(rows.where(F.col("vec_id") % 4 == 0).select("vec_id"))
    return _rounded(index.search(query_vector(spark, d), 10, ef=500, allowed=rows.where(F.col("label") < 3).select("vec_id")))


def _delete_payload(spark: SparkSession, d: str) -> DataFrame:
    """A column made null and a JSON path removed in some rows."""
    changed, _ = mutations.delete_payload(catalog(spark, d, "emb"), "emb", [str(i) for i in range(0, 40, 4)], ["label", "meta.half"])
    return changed.select(F.col("id").alias("vec_id"), F.coalesce("label", F.lit(-1)).alias("label"), F.get_json_object("metadata", "$.half").alias("half"), F.get_json_object("metadata", "$.label").alias("meta_label"))


def _clear_payload(spark: SparkSession, d: str) -> DataFrame:
    """All registered fields of some rows."""
    changed, _ = mutations.clear_payload(catalog(spark, d, "emb", docs=True), "emb", [str(i) for i in range(0, 40, 4)])
    return changed.select(F.col("id").alias("vec_id"), F.coalesce("label", F.lit(-1)).alias("label"), "tenant_id", F.get_json_object("metadata", "$.label").alias("meta_label"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, sparse vectors and filter fields of a collection, aliases, limits, models and migrations, as rows (kind, name, detail)."""
    c = catalog(spark, d, "emb", docs=True, terms=True)
    c.configure_limits("emb", max_search_limit=500, strict_mode=True)
    c.register_model_version("emb", "m", "1", 64, "cosine")
    c.register_model_version("emb", "m", "2", 64, "cosine")
    c.create_migration("emb", ("m", "1"), ("m", "2"), table(spark, d, "embeddings").count())
    c.update_migration(1, 10, "running")
    text = lambda *cols: F.concat_ws("/", *(F.col(x).cast("string") for x in cols))
    parts = [
        c.collection_vectors("emb").select(F.lit("vector").alias("kind"), F.col("vector_name").alias("name"), text("vector_column", "dimensions", "metric").alias("detail")),
        c.collection_vectors("emb", True).select(F.lit("sparse"), "vector_name", text("vector_column", "dimensions", "metric")),
        c.filter_fields("emb").select(F.lit("field"), "filter_key", "column_name"),
        c.collection_aliases().select(F.lit("alias"), "alias_name", "collection_name"),
        c.collection_limits("emb").select(F.lit("limit"), F.lit("max_search_limit"), text("max_search_limit", "strict_mode")),
        c.model_versions().select(F.lit("model"), text("model_name", "model_version"), text("dimensions", "metric")),
        c.embedding_migrations().select(F.lit("migration"), text("source_version", "target_version"), text("status", "processed_points", "total_points")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _optimization(spark: SparkSession, d: str) -> DataFrame:
    """State of a collection before and after an index is attached, and the advice for it."""
    c = catalog(spark, d, "emb", docs=True, terms=True)
    before = operations.optimization_status(c, "emb").select(F.lit("before").alias("stage"), "registered_vectors", "active_points", "filter_fields", "indexes", "status")
    advice = operations.index_advisor(c, "emb").groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
    search.build_index(c, "emb", scratch(spark, "attached"), "dense")
    after = operations.optimization_status(c, "emb").select(F.lit("after").alias("stage"), "registered_vectors", "active_points", "filter_fields", "indexes", "status")
    told = advice.select(F.lit("advice").alias("stage"), F.col("n").alias("registered_vectors"), F.lit(0).cast("bigint").alias("active_points"), F.lit(0).cast("bigint").alias("filter_fields"), F.lit(0).cast("bigint").alias("indexes"), F.col("recommendation").alias("status"))
    return before.unionByName(after).unionByName(told)


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """A build over all customers by steps that fails once and is retried, with its artifact; both are read back from where they are kept."""
    path = scratch(spark, "jobs")
    jobs = BuildJobs(spark, f"{path}/jobs")
    total = table(spark, d, "customer").count()
    job = jobs.start("customers", "vectors", "v", "t", total)
    failed = []

    def work(first: int, last: int) -> None:
        if first and not failed:
            failed.append(first)
            raise RuntimeError("lost")

    jobs.run(job.build_job_id, work, max(1, total // 4))
    job.retry()
    jobs.run(job.build_job_id, work, max(1, total // 4))
    kept = BuildJobs(spark, f"{path}/jobs")
    Artifacts(spark, f"{path}/artifacts", kept).publish(1, encode_segment("vectors", b"x" * total))
    again = Artifacts(spark, f"{path}/artifacts", kept)
    rows = kept.listing().select("build_job_id", "total_units", "processed_units", "attempt", "status")
    return rows.join(again.listing().select("build_job_id", "payload_bytes", "lifecycle_state"), "build_job_id").join(again.diagnostics().select(F.col("artifact_id").alias("build_job_id"), F.col("status").alias("artifact")), "build_job_id")


#: Recall that each way of searching an index must reach: its normal parameters and, for codes, candidates.
GATES = {"graph": 0.95, "graph_masked": 0.95, "scalar": 0.95, "binary": 0.75, "attached": 0.95}
SAMPLED = 50


def recalls(spark: SparkSession, d: str) -> dict[str, float]:
    """Recall of the first ten against the exact search, for up to SAMPLED rows as queries against all rows."""
    rows = table(spark, d, "embeddings")
    asked = drawn(rows, F.xxhash64("vec_id"), SAMPLED, rows.count()).select("vec_id", "embedding").collect()
    queries, some = [r[1] for r in asked], F.col("label") < 2
    of = spark.createDataFrame([(i, r[0]) for i, r in enumerate(asked)], "query int, query_id bigint")

    def recall(found: DataFrame, among: DataFrame) -> float:
        wanted = batch.batch_nearest(among, rows.join(F.broadcast(of.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi"), "vec_id", "embedding", 64, 10, "cosine")
        out = operations.recall_by_query(wanted.join(of, "query_id").select("query", "point_id"), found.select("query", "point_id"), "query", "point_id")
        return out.agg(F.sum("intersection_count") / F.sum("exact_count")).first()[0]

    shards = graph.GraphIndex.build(rows, "vec_id", "embedding", 64, "cosine", scratch(spark, "graph"), shard_rows=1000)
    lists = _index(spark, d)
    every = len(lists._properties()["centroids"])
    c = catalog(spark, d, "emb_cosine")
    c.attach_index("emb_cosine", "dense", f"{shards.table.path[:-7]}")
    one = [search.search(c, "emb_cosine", q, 10, strategy="index").select(F.lit(i).alias("query"), "point_id") for i, q in enumerate(queries[:5])]
    attached = one[0]
    for x in one[1:]:
        attached = attached.unionByName(x)
    few = of.where("query < 5")
    whole = batch.batch_nearest(rows, rows.join(F.broadcast(few.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi"), "vec_id", "embedding", 64, 10, "cosine").join(few, "query_id")
    hits = operations.recall_by_query(whole.select("query", "point_id"), attached, "query", "point_id").agg(F.sum("intersection_count") / F.sum("exact_count")).first()[0]
    return {
        "graph": recall(shards.search_many(queries, 10), rows), "graph_masked": recall(shards.search_many(queries, 10, allowed=rows.where(some).select("vec_id")), rows.where(some)),
        "scalar": recall(lists.search_many(queries, 10, every, None, "scalar", 50), rows), "binary": recall(lists.search_many(queries, 10, every, None, "binary", 150), rows), "attached": hits,
    }


def _index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether each way of searching an index reaches its recall: a graph with the default beam, plain and masked; stored codes with exact
    ordering of 50 or 150 candidates; and a collection's search over the graph attached to it."""
    found = recalls(spark, d)
    n = min(SAMPLED, table(spark, d, "embeddings").count())
    return spark.createDataFrame([(k, 5 if k == "attached" else n, GATES[k], v >= GATES[k]) for k, v in found.items()], "way string, queries bigint, least double, reached boolean")


def late_recall(spark: SparkSession, d: str) -> float:
    """Recall of the first ten points of late interaction over a graph of all usable tokens, against the exact search, for ten points' tokens as queries."""
    usable = (F.size("token_vector") == 48) & F.forall("token_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    tokens = table(spark, d, "late_interaction_tokens").where(usable & F.col("point_id").isNotNull() & F.col("token_id").isNotNull()).dropDuplicates(["token_id"])
    tokens = materialize(tokens.select("token_id", "point_id", "token_vector"), "tokens")
    points = tokens.select("point_id").distinct()
    c = Catalog(spark)
    c.register_table("points", points.select(F.col("point_id").alias("id")))
    c.create_collection("points", "points")
    c.adopt_points("points", points.select("point_id", F.col("point_id").cast("string").alias("source_key"), F.lit(None).alias("deleted_at")))
    index = graph.GraphIndex.build(tokens, "token_id", "token_vector", 48, "inner_product", scratch(spark, "tokens"), shard_rows=1000)
    chosen = drawn(points, F.xxhash64("point_id"), 10, points.count())
    asked = tokens.join(F.broadcast(chosen), "point_id", "left_semi").groupBy("point_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("token_id", "token_vector"))), 1, 3).alias("t")).collect()
    hits = total = 0
    for r in asked:
        queries = [list(t.token_vector) for t in r.t]
        exact = {x[0] for x in search.search_late_interaction_tokens(c, "points", queries, tokens, "point_id", "token_vector", 10_000, 10).select("point_id").collect()}
        found = {x[0] for x in search.search_late_interaction_tokens(c, "points", queries, tokens, "point_id", "token_vector", 50, 10, index, token="token_id").select("point_id").collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    return hits / total


def _late_ann(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0.95, late_recall(spark, d) >= 0.95)], "least double, reached boolean")


def _sparse_index(spark: SparkSession, d: str) -> postings.SparseIndex:
    rows = table(spark, d, "embeddings").select("vec_id", sparse_column(F.col("embedding")).alias("s"))
    return postings.SparseIndex.build(rows, "vec_id", "s", 64, "inner_product", scratch(spark, "postings"))


def _sparse_ann(spark: SparkSession, d: str) -> DataFrame:
    """Candidates out of the terms of the query, after some points were removed."""
    index = _sparse_index(spark, d)
    index.remove(table(spark, d, "embeddings").where(F.col("vec_id") % 7 == 1).select("vec_id"))
    return _rounded(index.candidates(sparse_query(spark, d), 12))


def _sparse_masked(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_sparse_index(spark, d).candidates(sparse_query(spark, d), 12, allowed=table(spark, d, "embeddings").where(F.col("label") < 3).select("vec_id")))


def _batch_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors for every 50th one."""
    rows = table(spark, d, "embeddings")
    return _rounded(batch.batch_nearest(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 64, 5, exclude_self=True))


def _lineitem_scan(spark: SparkSession, d: str) -> DataFrame:
    """Exact search over all line items with a filter that reaches the scan."""
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    rows = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.array(*(F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))).alias("v"))
    scored = rows.select(F.col("id").alias("source_key"), l2_distance(F.col("v"), [25.0, 30000.0, 0.05, 0.02]).alias("score"))
    return _rounded(scored.orderBy("score", "source_key").limit(100))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Changes between versions of a table, out of the manifests: rows per kind of change."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    t = VersionedTable(spark, scratch(spark, "versions"))
    t.commit(rows.where(F.col("c_nationkey") < 10))
    t.commit(rows.where(F.col("c_nationkey") >= 20), delete=F.col("c_nationkey") == 3)
    t.commit(delete=F.col("c_acctbal") < 0)
    return t.changes(1, 3).groupBy("_change").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    """An array column of token vectors as one row per token."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16)).alias("tokens"))
    return explode_tokens(rows, "tokens", 16).select("source_key", "token_ordinal", F.round(F.get("token", F.lit(0)).cast("double"), 6).alias("first"))


QUERIES = {
    **{f"search_{m}": _search(m) for m in _METRICS}, "search_alias": _search_alias, "search_filtered": _search_filtered, "search_json_filter": _search_json, "search_candidates": _search_candidates,
    "search_sparse": _search_sparse, "search_inline": _search_inline, "grouped_search": _grouped, "count_filtered": _count, "count_json": _count_json, "facet": _facet, "facet_json": _facet_json,
    "scroll": _scroll, "recommend": _recommend, "discover": _discover, "lookup": _lookup, "full_text": _full_text, "full_text_terms": _full_text_terms, "hybrid_text": _hybrid_text,
    "hybrid_sparse": _hybrid_sparse, "plan_weighted": _plan_weighted, "plan_formula": _plan_formula, "plan_explain": _plan_explain, "branch_fusion_all": _branch_fusion_all, "visible_points": _visible_points,
    "filter_documents": _filter_docs, "upsert_points": _upsert, "point_ids": _point_ids, "set_payload": _payload, "telemetry": _telemetry, "cohort_stats": _cohorts, "execution_stats": _executions,
    "recall_by_query": _recall, "index_exact": _index_all, "index_masked": _index_masked, "index_quantized": _index_quantized, "graph_search": _graph_search, "graph_masked": _graph_masked, "batch_knn": _batch_knn, "lineitem_scan": _lineitem_scan,
    "table_versions": _versions, "token_rows": _token_rows, "search_inline_sparse": _search_inline_sparse, "search_threshold": _search_threshold, "count_nested": _count_nested,
    "plan_recommend": _plan_of(query.recommend([1, 2, 3], [4, 5], 10)), "plan_discover": _plan_of(query.discover([7, 8], 10)), "plan_lookup": _plan_of(query.lookup([42, 7, 99_999_999, 13])),
    "plan_late": _plan_late, "search_late": _search_late, "delete_payload": _delete_payload, "clear_payload": _clear_payload, "listings": _listings, "optimization": _optimization, "build_jobs_kept": _jobs,
    "index_recall": _index_recall, "late_ann": _late_ann, "sparse_ann": _sparse_ann, "sparse_masked": _sparse_masked,
}

_E = "embedding::DOUBLE[]"
_CUT = f"list_transform({_E}, lambda x: CASE WHEN abs(x) >= {CUT} THEN x ELSE 0 END)"
_D = {"l2": f"list_distance({_E}, q)", "inner_product": f"-list_inner_product({_E}, q)", "cosine": f"list_cosine_distance({_E}, q)", "l1": l1(_E, "q")}
_ROWS = "(SELECT e.*, lower(d.lang) AS lang, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"


def _top(limit: int, metric: str = "cosine", where: str = "TRUE", q: int = 0, direction: str = "ASC") -> str:
    return f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, {_D[metric]} AS s FROM {_ROWS}, (SELECT {q_sql(q)} AS q) WHERE {where})
      ORDER BY s {direction}, vec_id LIMIT {limit}"""


def _mean(ids: str) -> str:
    return f"""(SELECT list(m ORDER BY pos) FROM (SELECT pos, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS pos, unnest({_E}) AS x FROM embeddings WHERE vec_id IN ({ids})) GROUP BY pos))"""


_DENSE = "SELECT vec_id, row_number() OVER (ORDER BY list_cosine_distance({e}, q), vec_id) AS r FROM embeddings, (SELECT {q} AS q) QUALIFY r <= {k}"
_LATE = f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, list_max(list_transform([0, 16, 32, 48], lambda i: list_inner_product(({_E})[i+1:i+16], q[1:16])))
    + list_max(list_transform([0, 16, 32, 48], lambda i: list_inner_product(({_E})[i+1:i+16], q[17:32]))) AS s FROM embeddings, (SELECT {q_sql()} AS q)) ORDER BY s DESC, vec_id LIMIT 10"""
_TERMS = "regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')"
_OCCURS = f"len(list_filter({_TERMS}, lambda t: t = '{TERM}'))"
_JSON = "json_extract(props, '$.k')"
SQL = {
    **{f"search_{m}": _top(10, m) for m in _METRICS},
    "search_alias": _top(25, q=3),
    "search_filtered": _top(20, where="label IN (1, 3, 5, 7) AND NOT lang = 'de'"),
    "search_json_filter": _top(20, where="label >= 2 AND label < 6 AND label % 2 = 1"),
    "search_candidates": _top(15, where="vec_id < 400 AND vec_id % 7 = 0 AND label >= 1"),
    "search_sparse": f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, -list_inner_product({_CUT}, q) AS s
        FROM embeddings, (SELECT {_CUT} AS q FROM embeddings WHERE vec_id = 0)) ORDER BY s, vec_id LIMIT 12""",
    "search_inline": _top(5, where="vec_id < 20", q=30).replace("vec_id::VARCHAR AS source_key, ", ""),
    "search_inline_sparse": f"""SELECT vec_id AS point_id, round(s, 6) AS score FROM (SELECT vec_id, -list_inner_product({_CUT}, q) AS s
        FROM embeddings, (SELECT {_CUT} AS q FROM embeddings WHERE vec_id = 30) WHERE vec_id < 20) ORDER BY s, vec_id LIMIT 5""",
    "search_threshold": f"SELECT * FROM ({_top(60)}) WHERE score BETWEEN 0.5 AND 0.8",
    "count_nested": f"SELECT count(*) AS count FROM {_ROWS} WHERE label >= 1 AND (lang = 'en' OR (label = 4 AND lang IS NOT NULL))",
    "sparse_ann": f"""SELECT vec_id AS point_id, round(s, 6) AS score FROM (SELECT vec_id, -list_inner_product({_CUT}, q) AS s
        FROM embeddings, (SELECT {_CUT} AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id % 7 <> 1) ORDER BY s, vec_id LIMIT 12""",
    "sparse_masked": f"""SELECT vec_id AS point_id, round(s, 6) AS score FROM (SELECT vec_id, -list_inner_product({_CUT}, q) AS s
        FROM embeddings, (SELECT {_CUT} AS q FROM embeddings WHERE vec_id = 0) WHERE label < 3) ORDER BY s, vec_id LIMIT 12""",
    "index_recall": "SELECT way, CASE way WHEN 'attached' THEN 5 ELSE least(50, (SELECT count(*) FROM embeddings)) END AS queries, least, TRUE AS reached FROM (VALUES ('graph', 0.95::DOUBLE), ('graph_masked', 0.95), ('scalar', 0.95), ('binary', 0.75), ('attached', 0.95)) t(way, least)",
    "late_ann": "SELECT 0.95::DOUBLE AS least, TRUE AS reached",
    "search_late": _LATE, "plan_late": _LATE,
    "delete_payload": """SELECT vec_id, CASE WHEN vec_id < 40 AND vec_id % 4 = 0 THEN -1 ELSE label END AS label, CASE WHEN vec_id < 40 AND vec_id % 4 = 0 THEN NULL ELSE (label % 2)::VARCHAR END AS half,
        label::VARCHAR AS meta_label FROM embeddings""",
    "clear_payload": f"""SELECT vec_id, CASE WHEN hit THEN -1 ELSE label END AS label, CASE WHEN hit THEN NULL ELSE tenant_id END AS tenant_id, CASE WHEN hit THEN NULL ELSE label::VARCHAR END AS meta_label
        FROM (SELECT e.*, d.tenant_id, vec_id < 40 AND vec_id % 4 = 0 AS hit FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)""",
    "listings": """SELECT * FROM (VALUES ('vector', 'dense', 'embedding/64/cosine'), ('sparse', 'terms', 'terms/64/inner_product'), ('field', 'label', 'label'), ('field', 'lang', 'lang'), ('field', 'tenant_id', 'tenant_id'),
        ('field', 'text', 'text'), ('field', 'meta.label', 'metadata'), ('field', 'meta.half', 'metadata'), ('alias', 'vectors', 'emb'), ('limit', 'max_search_limit', '500/true'), ('model', 'm/1', '64/cosine'),
        ('model', 'm/2', '64/cosine')) t(kind, name, detail) UNION ALL SELECT 'migration', '1/2', 'running/10/' || count(*) FROM embeddings""",
    "optimization": """SELECT stage, 2::BIGINT AS registered_vectors, (SELECT count(*) FROM embeddings) AS active_points, 6::BIGINT AS filter_fields, (stage = 'after')::BIGINT AS indexes, CASE stage WHEN 'after' THEN 'indexed' ELSE 'exact_only' END AS status
        FROM (VALUES ('before'), ('after')) t(stage) UNION ALL SELECT 'advice', n, 0, 0, 0, r FROM (VALUES (4, 'cluster_files'), (2, 'extract_column'), (1, 'build_index')) t(n, r)""",
    "build_jobs_kept": "SELECT 1::BIGINT AS build_job_id, n AS total_units, n AS processed_units, 2 AS attempt, 'completed' AS status, n AS payload_bytes, 'published' AS lifecycle_state, 'ready' AS artifact FROM (SELECT count(*) AS n FROM customer)",
    "grouped_search": f"""SELECT label::VARCHAR AS group_value, vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT label, vec_id, {_D["cosine"]} AS s
        FROM embeddings, (SELECT {q_sql()} AS q) WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) <= 3) ORDER BY s, vec_id LIMIT 30""",
    "count_filtered": "SELECT count(*) AS count FROM events WHERE event_type NOT IN ('click') AND ts >= TIMESTAMP '2024-01-15' AND NOT value < 10",
    "count_json": f"SELECT count(*) AS count FROM (SELECT TRY_CAST({_JSON} AS DOUBLE) AS k FROM events) WHERE k BETWEEN 20 AND 60 AND k NOT IN (33, 44)",
    "facet": "SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL AND value > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "facet_json": "SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "scroll": "SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key FROM embeddings WHERE vec_id > 0 ORDER BY vec_id LIMIT 100",
    "recommend": f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, list_distance({_E}, q) AS s FROM embeddings,
        (SELECT list_transform(list_zip({_mean("1, 2, 3")}, {_mean("4, 5")}), lambda p: p[1] - p[2]) AS q) WHERE vec_id NOT IN (1, 2, 3, 4, 5)) ORDER BY s, vec_id LIMIT 10""",
    "discover": f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, list_distance({_E}, q) AS s FROM embeddings, (SELECT {_mean("7, 8")} AS q)
        WHERE vec_id NOT IN (7, 8)) ORDER BY s DESC, vec_id LIMIT 10""",
    "lookup": "SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, CASE vec_id WHEN 42 THEN 0.0::DOUBLE WHEN 7 THEN -1.0 ELSE -3.0 END AS score FROM embeddings WHERE vec_id IN (42, 7, 13)",
    "full_text": f"SELECT doc_id AS point_id, round(0.1 * n::DOUBLE, 6) AS score FROM (SELECT doc_id, {_OCCURS} AS n FROM documents) WHERE n > 0 ORDER BY 2 DESC, 1 LIMIT 50",
    "full_text_terms": f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'query') AND list_contains(t, 'is')",
    "hybrid_text": f"""WITH a AS ({_DENSE.format(e=_E, q=q_sql(), k=10)}), b AS (SELECT vec_id, row_number() OVER (ORDER BY n DESC, vec_id) AS r FROM (SELECT vec_id, {_OCCURS} AS n FROM {_ROWS}) WHERE n > 0 QUALIFY r <= 10)
        SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) ORDER BY s DESC, vec_id LIMIT 10""",
    "hybrid_sparse": f"""WITH a AS ({_DENSE.format(e=_E, q=q_sql(), k=10)}), b AS (SELECT vec_id, row_number() OVER (ORDER BY -list_inner_product({_CUT}, q), vec_id) AS r FROM embeddings,
        (SELECT {_CUT} AS q FROM embeddings WHERE vec_id = 0) QUALIFY r <= 10)
        SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(s, 6) AS score FROM (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) ORDER BY s DESC, vec_id LIMIT 10""",
    "plan_weighted": f"""WITH a AS (SELECT vec_id, {_D["cosine"]} AS s FROM embeddings, (SELECT {q_sql()} AS q) ORDER BY s, vec_id LIMIT 20), b AS (SELECT vec_id, {_D["cosine"]} AS s FROM embeddings, (SELECT {q_sql(1)} AS q) ORDER BY s, vec_id LIMIT 20),
        u AS (SELECT vec_id, 0.75 * ((max(s) OVER () - s) / (max(s) OVER () - min(s) OVER ())) AS x FROM a UNION ALL SELECT vec_id, 0.25 * ((max(s) OVER () - s) / (max(s) OVER () - min(s) OVER ())) FROM b)
        SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round(t, 6) AS score FROM (SELECT vec_id, sum(x) AS t FROM u GROUP BY 1) ORDER BY t DESC, vec_id LIMIT 20""",
    "plan_formula": f"""SELECT vec_id AS point_id, vec_id::VARCHAR AS source_key, round((1 - s) * 2 - 0.125, 6) AS score FROM (SELECT vec_id, {_D["cosine"]} AS s FROM embeddings, (SELECT {q_sql()} AS q)
        ORDER BY s, vec_id LIMIT 40) WHERE s >= 0.1 ORDER BY (1 - s) * 2 - 0.125 DESC, vec_id LIMIT 12""",
    "plan_explain": """SELECT stage, branch, strategy, CASE stage WHEN 'prefetch' THEN 40 ELSE (SELECT count(*) FROM embeddings) END AS estimated_candidates, candidate_budget
        FROM (VALUES ('nearest', '0.0', 'exact', 20::BIGINT), ('full_text', '0.1', 'exact', 20), ('prefetch', '0', 'driver_plan', 20)) t(stage, branch, strategy, candidate_budget)""",
    "branch_fusion_all": """WITH r AS (SELECT query_id, point_id, lower(translate(c.branch, '_-', '')) AS b, CASE lower(s.score_order) WHEN 'lowerisbetter' THEN -score ELSE score END AS x
        FROM search_candidates c JOIN search_branches s ON lower(translate(c.branch, '_-', '')) = lower(translate(s.branch, '_-', '')) WHERE query_id IS NOT NULL AND point_id IS NOT NULL AND isfinite(score)),
        p AS (SELECT query_id, b, point_id, max(x) AS s FROM r GROUP BY 1, 2, 3), w AS (SELECT *, min(s) OVER q AS lo, max(s) OVER q AS hi, greatest(abs(lo), abs(hi)) AS m FROM p WINDOW q AS (PARTITION BY query_id, b))
        SELECT query_id, point_id, round(sum(CASE WHEN lo = hi THEN 1 ELSE (s / m - lo / m) / (hi / m - lo / m) END * CASE b WHEN 'denseexact' THEN 2 ELSE 1 END
        / (SELECT count(*) + 1.0::DOUBLE FROM (SELECT DISTINCT lower(translate(branch, '_-', '')) AS b FROM search_branches))), 6) AS score FROM w GROUP BY 1, 2""",
    "visible_points": """WITH v AS (SELECT point_id, collection_id, source_key, deleted_at IS NULL AS live FROM collection_points
        QUALIFY row_number() OVER (PARTITION BY point_id, collection_id ORDER BY greatest(created_at, updated_at, deleted_at) DESC NULLS LAST, (deleted_at IS NULL) DESC, source_key DESC) = 1)
        SELECT collection_id, count(*) AS n_points FROM v WHERE live AND source_key IN (SELECT id::VARCHAR FROM source_docs) GROUP BY 1""",
    "filter_documents": """SELECT DISTINCT id FROM source_docs WHERE json_type(TRY_CAST(metadata AS JSON), '$.rev') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND json_extract(TRY_CAST(metadata AS JSON), '$.rev')::DOUBLE >= 10
        AND json_exists(TRY_CAST(metadata AS JSON), '$.topic') AND json_extract_string(TRY_CAST(metadata AS JSON), '$.topic') IS DISTINCT FROM ''
        AND json_exists(TRY_CAST(metadata AS JSON), '$.language') AND json_extract_string(TRY_CAST(metadata AS JSON), '$.language') IS DISTINCT FROM 'en'""",
    "upsert_points": """SELECT batch_number, count(*) AS processed_count, sum((k % 3 <> 0)::INT)::BIGINT AS inserted_count, sum((k % 6 = 0)::INT)::BIGINT AS reactivated_count
        FROM (SELECT c_custkey AS k, ((row_number() OVER (ORDER BY c_custkey::VARCHAR) - 1) // 100 + 1)::BIGINT AS batch_number FROM customer) GROUP BY 1""",
    "point_ids": "SELECT row_number() OVER (ORDER BY s_suppkey::VARCHAR) AS point_id, s_suppkey::VARCHAR AS source_key, TRUE AS inserted FROM supplier",
    "set_payload": """SELECT vec_id, CASE WHEN vec_id < 40 AND vec_id % 4 = 0 THEN 77 ELSE label END AS label, CASE WHEN vec_id < 40 AND vec_id % 4 = 0 THEN 'x' ELSE (label % 2)::VARCHAR END AS half,
        label::VARCHAR AS meta_label FROM embeddings""",
    "telemetry": """SELECT 'emb' || suffix AS collection_name, 2::BIGINT AS registered_vectors, (SELECT count(*) FROM embeddings) AS active_points, 0::BIGINT AS deleted_points, 'active' AS status
        FROM (VALUES (''), ('_l2'), ('_inner_product'), ('_cosine'), ('_l1')) t(suffix) UNION ALL SELECT 'events', 1, (SELECT count(*) FROM events), 0, 'active'""",
    "cohort_stats": """SELECT 'c' || (user_id % 7)::VARCHAR AS cohort, event_type AS query_kind, count(*) AS query_count, sum(event_id)::BIGINT AS total_results, 3 * count(*) AS total_rows_rechecked,
        round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY 1, 2""",
    "execution_stats": """SELECT event_type AS query_kind, CASE WHEN value < 1 THEN 'lt_1ms' WHEN value < 10 THEN 'lt_10ms' WHEN value < 100 THEN 'lt_100ms' WHEN value < 1000 THEN 'lt_1s' WHEN value >= 1000 THEN 'gte_1s'
        ELSE 'unspecified' END AS latency_bucket, count(*) AS query_count, sum(event_id)::BIGINT AS total_candidates, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY 1, 2""",
    "recall_by_query": """WITH r AS (SELECT query_id, point_id, max((score > 0.25)::INT) AS a, max((score > 0.5)::INT) AS b FROM hydrated_candidates WHERE NOT isnan(score) AND score > 0.25 GROUP BY 1, 2)
        SELECT query_id, sum(a)::BIGINT AS exact_count, sum(b)::BIGINT AS candidate_count, sum(a * b)::BIGINT AS intersection_count, round(sum(a * b) / sum(a), 6) AS recall FROM r GROUP BY 1""",
    "index_exact": _top(20, where="vec_id % 5 <> 0 OR vec_id % 10 = 0").replace("vec_id::VARCHAR AS source_key, ", ""),
    "index_masked": _top(10, where="label = 3").replace("vec_id::VARCHAR AS source_key, ", ""),
    "index_quantized": _top(10).replace("vec_id::VARCHAR AS source_key, ", ""),
    "graph_search": _top(10).replace("vec_id::VARCHAR AS source_key, ", ""),
    "graph_masked": _top(10, where="label < 3 AND vec_id % 4 <> 0").replace("vec_id::VARCHAR AS source_key, ", ""),
    "batch_knn": f"""SELECT query_id, point_id, place::INT AS place, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS point_id, list_distance(b.{_E}, a.{_E}) AS s,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY s, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE place <= 5""",
    "lineitem_scan": """SELECT source_key, round(s, 6) AS score FROM (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS source_key,
        list_distance([l_quantity::FLOAT::DOUBLE, l_extendedprice::FLOAT::DOUBLE, l_discount::FLOAT::DOUBLE, l_tax::FLOAT::DOUBLE], [25.0::DOUBLE, 30000, 0.05, 0.02]) AS s FROM lineitem WHERE l_returnflag = 'R')
        ORDER BY s, source_key LIMIT 100""",
    "table_versions": """SELECT 'delete' AS _change, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_nationkey < 10 AND (c_nationkey = 3 OR c_acctbal < 0)
        UNION ALL SELECT 'insert', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_nationkey >= 20 AND NOT c_acctbal < 0""",
    "token_rows": "SELECT vec_id::VARCHAR AS source_key, (i + 1)::INT AS token_ordinal, round(embedding[i * 16 + 1]::DOUBLE, 6) AS first FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS i)",
}
SQL |= {"plan_recommend": SQL["recommend"], "plan_discover": SQL["discover"], "plan_lookup": SQL["lookup"]}
