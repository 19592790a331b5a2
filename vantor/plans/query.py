"""Composite queries: plan nodes, their JSON form, builders, and the compiler to a DataFrame.

A plan is a tree. Its leaves retrieve points (nearest, sparse_nearest, full_text, late_interaction, recommend, discover,
lookup), its inner nodes change or fuse rankings (prefetch, weight, score_threshold, formula, rerank).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.errors import BudgetExceeded, InvalidParameter
from vantor.functions import sparse, vectors
from vantor.operators import ann, fusion, late, search, text
from vantor.plans.filters import parse as parse_filter
from vantor.plans.formula import Formula
from vantor.sources.catalog import Catalog, check_limit

MAX_DEPTH, MAX_NODES = 32, 256
#: Each kind's keys; a question mark marks one that may be left out.
KEYS = {
    "nearest": ("vector_name?", "vector", "filter?", "limit"),
    "sparse_nearest": ("vector_name", "vector", "filter?", "limit"),
    "full_text": ("text_query", "text_column", "limit"),
    "late_interaction": ("query_vectors", "candidates_per_query", "limit"),
    "recommend": ("positive_point_ids", "negative_point_ids", "limit"),
    "discover": ("context_point_ids", "limit"),
    "lookup": ("point_ids",),
    "prefetch": ("branches",),
    "weight": ("weight", "branch"),
    "score_threshold": ("min_score", "max_score", "branch"),
    "formula": ("formula", "branch"),
    "rerank": ("limit", "branch"),
}
Plan = Mapping[str, object]


@dataclass(frozen=True)
class Ranking:
    """A compiled node: its rows, whether lower scores are better, and how many rows it can have."""

    rows: DataFrame
    lower_is_better: bool
    limit: int


# builders


def nearest(vector: Sequence[float], limit: int, vector_name: str | None = None, filter: Mapping | None = None) -> dict:
    node = {"kind": "nearest", "vector": vectors.check_vector(vector), "limit": limit}
    return node | ({"vector_name": vector_name} if vector_name is not None else {}) | ({"filter": filter} if filter is not None else {})


def sparse_nearest(vector_name: str, vector: sparse.Sparse | str, limit: int, filter: Mapping | None = None) -> dict:
    node = {"kind": "sparse_nearest", "vector_name": vector_name, "vector": str(sparse.literal(vector)), "limit": limit}
    return node | ({"filter": filter} if filter is not None else {})


def full_text(text_query: str, text_column: str, limit: int) -> dict:
    return {"kind": "full_text", "text_query": text_query, "text_column": text_column, "limit": limit}


def late_interaction(query_vectors: Sequence[Sequence[float]], candidates_per_query: int, limit: int) -> dict:
    return {"kind": "late_interaction", "query_vectors": late.check_queries(query_vectors), "candidates_per_query": candidates_per_query, "limit": limit}


def recommend(positive_point_ids: Sequence[int], negative_point_ids: Sequence[int], limit: int) -> dict:
    return {"kind": "recommend", "positive_point_ids": list(positive_point_ids), "negative_point_ids": list(negative_point_ids), "limit": limit}


def discover(context_point_ids: Sequence[int], limit: int) -> dict:
    return {"kind": "discover", "context_point_ids": list(context_point_ids), "limit": limit}


def lookup(point_ids: Sequence[int]) -> dict:
    return {"kind": "lookup", "point_ids": list(point_ids)}


def prefetch(branches: Sequence[Plan]) -> dict:
    return {"kind": "prefetch", "branches": list(branches)}


def weight(branch: Plan, weight: float) -> dict:
    return {"kind": "weight", "weight": weight, "branch": branch}


def score_threshold(branch: Plan, min_score: float | None, max_score: float | None) -> dict:
    return {"kind": "score_threshold", "min_score": min_score, "max_score": max_score, "branch": branch}


def formula(branch: Plan, formula: str) -> dict:
    return {"kind": "formula", "formula": formula, "branch": branch}


def rerank(branch: Plan, limit: int) -> dict:
    return {"kind": "rerank", "limit": limit, "branch": branch}


# checking


def parse(plan: str | Plan) -> Plan:
    """The checked plan of a JSON text or object: known kinds and keys, sound values, bounded depth and size."""
    try:
        plan = json.loads(plan) if isinstance(plan, str) else plan
    except json.JSONDecodeError as e:
        raise InvalidParameter(f"a plan must be JSON: {e}") from e
    _check(plan, 1, [0])
    return plan


def _ids(value: object, least: int) -> list[int]:
    if not isinstance(value, list) or any(not isinstance(i, int) or isinstance(i, bool) or i <= 0 for i in value):
        raise InvalidParameter("point ids must be a list of positive integers")
    if len(value) < least:
        raise InvalidParameter("an example point is needed")
    return value


def _finite(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise InvalidParameter(f"{what} must be a finite number")
    return float(value)


def _check(n: object, depth: int, count: list[int]) -> None:
    count[0] += 1
    if depth > MAX_DEPTH or count[0] > MAX_NODES:
        raise BudgetExceeded("plan is too deep or too large")
    if not isinstance(n, Mapping) or n.get("kind") not in KEYS:
        raise InvalidParameter("a plan node needs a known kind")
    kind = n["kind"]
    names = {k.rstrip("?") for k in KEYS[kind]}
    if unknown := set(n) - names - {"kind"}:
        raise InvalidParameter(f"{kind} has no key {sorted(unknown)[0]}")
    if missing := {k for k in KEYS[kind] if not k.endswith("?")} - set(n):
        raise InvalidParameter(f"{kind} needs the key {sorted(missing)[0]}")
    if "limit" in names:
        check_limit(n["limit"])
    if n.get("filter") is not None:
        parse_filter(n["filter"])
    if kind == "nearest":
        vectors.check_vector(n["vector"])
    elif kind == "sparse_nearest":
        sparse.literal(n["vector"])
    elif kind == "full_text":
        text.check_query(n["text_query"], n["text_column"])
    elif kind == "late_interaction":
        late.check_queries(n["query_vectors"])
        check_limit(n["candidates_per_query"])
    elif kind == "recommend":
        if len(_ids(n["positive_point_ids"], 1)) + len(_ids(n["negative_point_ids"], 0)) > 10_000:
            raise BudgetExceeded("too many example points")
    elif kind == "discover":
        _ids(n["context_point_ids"], 1)
    elif kind == "lookup":
        check_limit(len(_ids(n["point_ids"], 1)))
    elif kind == "prefetch":
        if not isinstance(n["branches"], list) or not n["branches"]:
            raise InvalidParameter("prefetch needs branches")
        for b in n["branches"]:
            _check(b, depth + 1, count)
    elif kind == "weight":
        if _finite(n["weight"], "a weight") < 0:
            raise InvalidParameter("a weight must not be negative")
    elif kind == "score_threshold":
        bounds = [_finite(n[k], k) for k in ("min_score", "max_score") if n[k] is not None]
        if len(bounds) == 2 and bounds[0] > bounds[1]:
            raise InvalidParameter("min_score exceeds max_score")
    elif kind == "formula":
        Formula(n["formula"])
    if "branch" in names:
        _check(n["branch"], depth + 1, count)


# compiling


class Executor:
    """Compiles plans over one collection."""

    def __init__(self, catalog: Catalog, collection: str) -> None:
        self.catalog, self.collection = catalog, collection

    def compile(self, n: Plan) -> Ranking:
        return getattr(self, "_" + n["kind"])(n)

    def _nearest(self, n: Plan) -> Ranking:
        rows = search.search(self.catalog, self.collection, n["vector"], n["limit"], name=n.get("vector_name"), filter=n.get("filter"))
        return Ranking(rows, True, n["limit"])

    def _sparse_nearest(self, n: Plan) -> Ranking:
        return Ranking(search.search_sparse(self.catalog, self.collection, n["vector_name"], n["vector"], n["limit"], n.get("filter")), True, n["limit"])

    def _full_text(self, n: Plan) -> Ranking:
        return Ranking(search.search_full_text(self.catalog, self.collection, n["text_query"], n["text_column"], n["limit"]), False, n["limit"])

    def _late_interaction(self, n: Plan) -> Ranking:
        c = self.catalog.resolve(self.collection)
        if c.tokens is None:
            raise InvalidParameter("the collection has no registered tokens")
        table, column = c.tokens
        exploded = self.catalog.tables[table].select(F.col("id"), F.explode(f"`{column}`").alias("token"))
        rows = search.search_late_interaction_tokens(self.catalog, self.collection, n["query_vectors"], exploded, "id", "token", n["candidates_per_query"], n["limit"])
        return Ranking(rows, False, n["limit"])

    def _recommend(self, n: Plan) -> Ranking:
        return Ranking(search.recommend(self.catalog, self.collection, n["positive_point_ids"], n["negative_point_ids"], n["limit"]), True, n["limit"])

    def _discover(self, n: Plan) -> Ranking:
        return Ranking(search.discover(self.catalog, self.collection, n["context_point_ids"], n["limit"]), False, n["limit"])

    def _lookup(self, n: Plan) -> Ranking:
        return Ranking(search.lookup(self.catalog, self.collection, n["point_ids"]), False, len(n["point_ids"]))

    def _prefetch(self, n: Plan) -> Ranking:
        """Weighted fusion if a direct branch is a weight node (the others weigh 1), else reciprocal rank fusion."""
        parts = [self.compile(b) for b in n["branches"]]
        limit = max(p.limit for p in parts)
        named = any(b["kind"] == "weight" for b in n["branches"])
        branches = [fusion.Branch(p.rows, p.lower_is_better, float(b.get("weight", 1.0)) if b["kind"] == "weight" else 1.0) for p, b in zip(parts, n["branches"], strict=True)]
        fused = fusion.weighted(branches) if named else fusion.rrf(branches)
        return Ranking(search.top(fused, limit, descending=True), False, limit)

    def _weight(self, n: Plan) -> Ranking:
        return self.compile(n["branch"])

    def _score_threshold(self, n: Plan) -> Ranking:
        child = self.compile(n["branch"])
        rows = child.rows
        if n["min_score"] is not None:
            rows = rows.where(F.col("score") >= float(n["min_score"]))
        if n["max_score"] is not None:
            rows = rows.where(F.col("score") <= float(n["max_score"]))
        return Ranking(rows, child.lower_is_better, child.limit)

    def _formula(self, n: Plan) -> Ranking:
        """The formula's values, the higher the better whatever the child's direction."""
        child, f = self.compile(n["branch"]), Formula(n["formula"])
        f.check(child.limit)
        return Ranking(child.rows.withColumn("score", f.column(F.col("score"))), False, child.limit)

    def _rerank(self, n: Plan) -> Ranking:
        """The child's rows in its own direction, cut to the limit; a point that comes twice keeps its best score."""
        child = self.compile(n["branch"])
        best = F.min("score") if child.lower_is_better else F.max("score")
        rows = child.rows.groupBy("point_id").agg(F.min("source_key").alias("source_key"), best.alias("score"))
        return Ranking(search.top(rows, n["limit"], not child.lower_is_better), child.lower_is_better, n["limit"])


def execute(catalog: Catalog, collection: str, plan: str | Plan) -> DataFrame:
    """Rows (point_id, source_key, score) of a plan, best first."""
    plan = parse(plan)
    r = Executor(catalog, collection).compile(plan)
    return search.top(r.rows, max(1, r.limit), not r.lower_is_better)


def hybrid_text(catalog: Catalog, collection: str, vector: Sequence[float], text_query: str, text_column: str, limit: int) -> DataFrame:
    """Dense and full-text branches, each cut to the limit, by reciprocal rank fusion."""
    return execute(catalog, collection, rerank(prefetch([nearest(vector, limit), full_text(text_query, text_column, limit)]), limit))


def hybrid_sparse(catalog: Catalog, collection: str, vector: Sequence[float], sparse_name: str, sparse_vector: sparse.Sparse | str, limit: int) -> DataFrame:
    return execute(catalog, collection, rerank(prefetch([nearest(vector, limit), sparse_nearest(sparse_name, sparse_vector, limit)]), limit))


# explaining

_EXPLAIN = "stage string, detail string, branch string, strategy string, status string, estimated_candidates bigint, candidate_budget bigint"
_DETAILS: dict[str, Callable[[Plan], str]] = {
    "nearest": lambda n: "order by distance to a vector" + (", filtered" if n.get("filter") else ""),
    "sparse_nearest": lambda n: "order by distance to a sparse vector" + (", filtered" if n.get("filter") else ""),
    "full_text": lambda n: f"all terms in {n['text_column']}, by cover density",
    "late_interaction": lambda n: f"{len(n['query_vectors'])} query vectors over tokens",
    "recommend": lambda n: "nearest to the examples' mean",
    "discover": lambda n: "farthest from the context's mean",
    "lookup": lambda n: "given points in order",
    "prefetch": lambda n: "weighted fusion" if any(b["kind"] == "weight" for b in n["branches"]) else "reciprocal rank fusion",
    "weight": lambda n: f"weight {n['weight']}",
    "score_threshold": lambda n: "bounds on the score",
    "formula": lambda n: n["formula"],
    "rerank": lambda n: "best score per point, cut to the limit",
}


def explain(catalog: Catalog, collection: str, plan: str | Plan) -> DataFrame:
    """One row per node of a plan, the leaves first, with strategy, candidates at hand and budget."""
    plan, c = parse(plan), catalog.resolve(collection)
    points = catalog.active(c).count()
    rows: list[tuple] = []

    def walk(n: Plan, at: str) -> int:
        children = n.get("branches") or ([n["branch"]] if "branch" in n else [])
        sizes = [walk(b, f"{at}.{i}") for i, b in enumerate(children)]
        leaf = not children
        limit = n.get("limit") or (len(n["point_ids"]) if n["kind"] == "lookup" else max(sizes, default=points))
        strategy = "exact" if leaf else "driver_plan"
        if n["kind"] == "nearest" and search.chosen_index(catalog, catalog.vector(c, n.get("vector_name"))) is not None:
            strategy = "index"
        rows.append((n["kind"], _DETAILS[n["kind"]](n), at, strategy, "ready", points if leaf else sum(sizes), limit))
        return limit

    walk(plan, "0")
    return catalog.spark.createDataFrame(rows, _EXPLAIN)


def explain_hybrid(catalog: Catalog, collection: str, text_column: str) -> DataFrame:
    """The stages of a dense and full-text query."""
    c = catalog.resolve(collection)
    e = catalog.vector(c)
    points = catalog.active(c).count()
    return catalog.spark.createDataFrame(
        [
            ("dense", f"{e.metric} over {e.column}", "dense", "exact" if search.chosen_index(catalog, e) is None else "index", "ready", points, 10_000),
            ("full_text", f"all terms in {text_column}", "text", "exact", "ready", points, 10_000),
            ("fusion", "reciprocal rank fusion", "fused", "rrf", "ready", 2 * points, 10_000),
        ],
        _EXPLAIN,
    )


def explain_sparse(catalog: Catalog, collection: str, name: str, query: sparse.Sparse | str, limit: int) -> DataFrame:
    """One row (strategy, active_points, scored_count, candidate_count, recheck_count)."""
    c = catalog.resolve(collection)
    e = catalog.vector(c, name, sparse=True)
    sparse.literal(query)
    check_limit(limit)
    scored = search.project(catalog, c, {}, where=F.col(f"`{e.column}`").isNotNull()).count()
    return catalog.spark.createDataFrame([("exact", catalog.active(c).count(), scored, min(limit, scored), 0)], "strategy string, active_points bigint, scored_count bigint, candidate_count bigint, recheck_count bigint")


def explain_late_interaction_ann(catalog: Catalog, collection: str, queries: Sequence[Sequence[float]], index: ann.AnnIndex, candidates: int, probes: int = 8) -> DataFrame:
    """The stages of a late-interaction query over an index of its tokens, with the index's state and the tokens its probed lists hold."""
    c = catalog.resolve(collection)
    wanted = late.check_queries(queries)
    state = index.status().first()["status"]
    held = index._probed_rows(wanted, probes, None, ["point_id"])[0].count() if state == "ready" else 0
    points = catalog.active(c).count()
    rows = [
        ("probe", f"{probes} lists for each of {len(wanted)} query vectors", "tokens", "index", state, held, held),
        ("candidates", f"{candidates} tokens for each query vector choose points", "tokens", "token_topk", state, min(held, len(wanted) * candidates), len(wanted) * candidates),
        ("score", "sum of best products over all tokens of the chosen points", "points", "exact", "ready", min(points, len(wanted) * candidates), late.MAX_COMPARISONS),
    ]
    return catalog.spark.createDataFrame(rows, _EXPLAIN)


def explain_late_interaction(catalog: Catalog, collection: str, queries: Sequence[Sequence[float]], column: str, candidates: int | None = None) -> DataFrame:
    """The stages of a late-interaction query, exact or by token candidates."""
    c = catalog.resolve(collection)
    wanted = late.check_queries(queries)
    points = catalog.active(c).count()
    rows = []
    if candidates is not None:
        rows.append(("candidates", f"{candidates} tokens for each of {len(wanted)} query vectors", "tokens", "token_topk", "ready", len(wanted) * candidates, len(wanted) * candidates))
    rows.append(("score", f"sum of best products over {column}", "points", "exact", "ready", points if candidates is None else min(points, len(wanted) * candidates), late.MAX_COMPARISONS))
    return catalog.spark.createDataFrame(rows, _EXPLAIN)
