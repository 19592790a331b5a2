"""Queries over the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm import bpe, cluster, fuse, knn, mix, quality, split, topn
from vantor.runtime import table


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_kinds(table(spark, d, "source_docs"), "id", "body")


def _p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "source_docs"), "id", "body")


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster.group_pairs(cluster.find_clusters(table(spark, d, "source_docs"), "id", "embedding", 64), "id")


def _p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "source_docs")
    return cluster.describe(cluster.find_clusters(docs, "id", "embedding", 64), docs, "id", "category")


_VECTORS = (("embedding", "source_docs", "id", 64), ("token_vector", "late_interaction_tokens", "token_id", 48))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (knn.similar_pairs(knn.nearest(table(spark, d, t), key, column, dim, floor=0.85), column) for column, t, key, dim in _VECTORS)
    return one.unionByName(two)


def _p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors, of whatever similarity, for every key divisible by 50, against all rows."""
    one, two = (
        knn.nearest(table(spark, d, t), key, column, dim, probes=64, probe_share=0.25, queries=F.col(key) % 50 == 0).select(
            F.lit(column).alias("field"), "key_a", "key_b", F.round("similarity", 9).alias("similarity"), "place"
        )
        for column, t, key, dim in _VECTORS
    )
    return one.unionByName(two)


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_per_category(table(spark, d, "hydrated_candidates")).select("category", "point_id")


def _p5_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_per_category(table(spark, d, "hydrated_candidates"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fuse(table(spark, d, "search_candidates"), table(spark, d, "search_branches"))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fuse.clear_winners(_fused(spark, d))


def _p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "point_id", "score", "place")


def _p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mix.unreachable(mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def _p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].select("doc_id", "source", "copy", "n_tokens")


def _p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def _p9_figures(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_figures(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[1:]: f for name, f in globals().items() if name.startswith("_p") and callable(f)}


_TRIM = "regexp_replace({}, '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g')"
_FINITE = "score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)"
_TOP = f"""
  SELECT category, point_id, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, point_id) AS place FROM (
    SELECT lower({_TRIM.format("category")}) AS category, point_id, max(score) AS score FROM hydrated_candidates
    WHERE category IS NOT NULL AND point_id IS NOT NULL AND {_FINITE} GROUP BY 1, 2) WHERE category <> ''"""
_PLACED = f"""
  SELECT query_id, branch, point_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY best DESC, point_id) AS place FROM (
    SELECT c.query_id, b.branch, c.point_id, max(CASE WHEN b.score_order = 'LowerIsBetter' THEN -c.score ELSE c.score END) AS best
    FROM search_candidates c JOIN search_branches b ON lower(translate(c.branch, '_-', '')) = lower(translate(b.branch, '_-', ''))
    WHERE {_FINITE} AND query_id IS NOT NULL AND point_id IS NOT NULL GROUP BY 1, 2, 3)"""
_FUSED = f"""
  WITH placed AS ({_PLACED}), n AS (SELECT query_id, count(DISTINCT branch) AS of_branches FROM placed GROUP BY 1), s AS (
    SELECT query_id, point_id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score, count(*) AS k, max(place) AS worst, any_value(of_branches) AS of_branches
    FROM placed JOIN n USING (query_id) GROUP BY 1, 2)
  SELECT query_id, point_id, score, k = of_branches AND worst <= 2 AS agreed, of_branches,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS place FROM s"""


def _unit(table: str, key: str, column: str, dims: int) -> str:
    """Usable vectors, one per key."""
    ok = f"len({column}) = {dims} AND len(list_filter({column}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({column}, lambda x: x <> 0)) > 0"
    return f"(SELECT {key} AS k, any_value({column}::DOUBLE[]) AS v FROM {table} WHERE {key} IS NOT NULL AND CASE WHEN {column} IS NULL THEN FALSE ELSE {ok} END GROUP BY 1)"


def _near(where: str, floor: float) -> str:
    parts = []
    for column, t, key, dims in _VECTORS:
        u = _unit(t, key, column, dims)
        parts.append(f"""SELECT '{column}' AS field, a.k AS key_a, b.k AS key_b, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.k ORDER BY s DESC, b.k) AS place
          FROM (SELECT * FROM {u} WHERE {where}) a JOIN {u} b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= {floor} QUALIFY place <= 5""")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    breaks = " \\t\\r\\n.!?;。！？；"
    return {
        # DuckDB's regular expressions allow at most 1,000 repeats, so the longest run is measured instead
        "p1_found": f"""SELECT id, CASE WHEN max(list_max(list_transform(regexp_split_to_array(body, '[{breaks}]'), lambda r: length(r)))) > 1500
          THEN 'forced' ELSE 'natural' END AS kind FROM source_docs WHERE length(body) > 1500 GROUP BY id""",
        "p2_found": f"""WITH u AS {_unit("source_docs", "id", "embedding", 64)}, g AS (SELECT a.k, min(b.k) AS low FROM u a JOIN u b ON list_cosine_similarity(a.v, b.v) >= 0.85 GROUP BY 1)
          SELECT low AS id_a, k AS id_b FROM g QUALIFY count(*) OVER (PARTITION BY low) >= 5 AND k <> low""",
        "p3_found": f"SELECT DISTINCT field, least(key_a, key_b) AS key_a, greatest(key_a, key_b) AS key_b FROM ({_near('TRUE', 0.85)})",
        "p3_neighbours": f"SELECT field, key_a, key_b, round(s, 9) AS similarity, place::INT AS place FROM ({_near('k % 50 = 0', -2)})",
        "p5_found": f"SELECT category, point_id FROM ({_TOP}) WHERE place <= 10",
        "p5_top": f"SELECT category, point_id, score, place FROM ({_TOP}) WHERE place <= 10",
        "p6_found": f"""SELECT query_id, point_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({_FUSED}) WHERE agreed AND of_branches >= 2) WHERE n = 1 AND place = 1""",
        "p6_ranking": f"SELECT query_id, point_id, score, place FROM ({_FUSED})",
    }
