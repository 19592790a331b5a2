"""Queries over vector functions, aggregates, quantization and late interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.functions import bits, half, quantize, register, sparse, vectors
from vantor.operators import aggregates, late, search
from vantor.runtime import table

DIMS, CUT = 64, 0.15


def _v() -> Column:
    return F.col("embedding")


def query_vector(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    """The vector of one row, as a constant."""
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == i).select("embedding").first()[0]]


def _distances(spark: SparkSession, d: str) -> DataFrame:
    q = query_vector(spark, d)
    names = {"l2": vectors.l2_distance, "l1": vectors.l1_distance, "ip": vectors.inner_product, "nip": vectors.negative_inner_product, "cosine": vectors.cosine_distance}
    return table(spark, d, "embeddings").select("vec_id", vectors.dims(_v()).alias("dims"), *(F.round(f(_v(), q), 6).alias(n) for n, f in names.items()))


def _pair_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of two columns: each vector with the one whose id is the next."""
    a = table(spark, d, "embeddings").select("vec_id", _v().alias("a"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), _v().alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.l2_distance(x, y), 6).alias("l2"), F.round(vectors.cosine_distance(x, y), 6).alias("cosine"), vectors.compare(x, y).alias("cmp"), (x < y).alias("lt"), (x == y).alias("eq"))


def _sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions registered for SQL."""
    register.register(spark)
    q = "array(" + ", ".join(f"{x!r}D" for x in query_vector(spark, d, 1)) + ")"
    table(spark, d, "embeddings").createOrReplaceTempView("vantor_embeddings")
    return spark.sql(f"SELECT vec_id, round(l2_distance(embedding, {q}), 6) AS l2, round(inner_product(embedding, {q}), 6) AS ip, round(cosine_distance(embedding, {q}), 6) AS cosine, vector_dims(embedding) AS dims FROM vantor_embeddings")


def _sql_families(spark: SparkSession, d: str) -> DataFrame:
    """The functions for half, sparse and bit vectors in SQL, against one row."""
    register.register(spark)
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", sparse_column(_v()).alias("s")).where(F.size("s.indices") > 0)
    rows.createOrReplaceTempView("vantor_families")
    one = sparse_query(spark, d)
    q = f"named_struct('dims', {one.dims}, 'indices', array({', '.join(map(str, one.indices))}), 'values', array({', '.join(f'CAST({x!r}D AS FLOAT)' for x in one.values)}))"
    bits = "array(" + ", ".join("true" if x >= 0 else "false" for x in query_vector(spark, d)) + ")"
    return spark.sql(f"""SELECT vec_id, round(sparsevec_l2_distance(s, q), 6) AS l2, round(sparsevec_l1_distance(s, q), 6) AS l1, round(sparsevec_inner_product(s, q), 6) AS ip, round(sparsevec_cosine_distance(s, q), 6) AS cosine,
        sparsevec_nnz(s) AS entries, round(aggregate(sparsevec_to_vector(s), 0D, (x, y) -> x + y), 5) AS total, bit_cmp(b, {bits}) AS cmp, bit_count_set(b) AS ones,
        round(aggregate(to_halfvec(embedding), 0D, (x, y) -> x + y), 6) AS half_total FROM (SELECT *, {q} AS q, binary_quantize(embedding) AS b FROM vantor_families)""")


def _text_form(spark: SparkSession, d: str) -> DataFrame:
    """Text form there and back."""
    rows = table(spark, d, "embeddings").select("vec_id", vectors.parse(vectors.to_text(_v())).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.round(total, 6).alias("total"), F.get("w", F.lit(63)).cast("double").alias("last"), vectors.dims(F.col("w")).alias("dims"))


def _half(spark: SparkSession, d: str) -> DataFrame:
    """Half-precision rounding: the first value and the sum, and the distance from the next vector's rounded values."""
    rows = table(spark, d, "embeddings").select("vec_id", half.from_array(_v()).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.get("h", F.lit(0)).cast("double").alias("first"), F.round(total, 6).alias("total"), F.round(half.l2_distance(F.col("h"), half.from_array(F.array(*[F.lit(0.1)] * DIMS))), 6).alias("l2"))


def _half_avg(spark: SparkSession, d: str) -> DataFrame:
    """The average of half vectors, as a half vector: its sum, which is what the rounding leaves."""
    rows = table(spark, d, "embeddings").select("label", half.from_array(_v()).alias("h"))
    rows = aggregates.aggregate_vectors(rows, ["label"], "h", "avg", DIMS, half=True)
    return rows.select("label", F.size("value").alias("dims"), F.round(F.aggregate("value", F.lit(0.0), lambda s, x: s + x.cast("double")), 2).alias("total"))


def _sparse_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", sparse_column(_v()).alias("s"))
    rows = aggregates.aggregate_sparse(rows, ["label"], "s", "avg")
    zipped = F.explode(F.arrays_zip(F.col("value.indices").alias("i"), F.col("value.values").alias("x"))).alias("e")
    return rows.select("label", zipped).select("label", F.col("e.i").alias("pos"), (F.round(F.col("e.x").cast("double"), 4) + 0.0).alias("x"))


def _binary_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Hamming and Jaccard distance of vectors of zeros and ones, against the signs of one row."""
    signs = F.transform(_v(), lambda x: F.when(x >= 0, 1.0).otherwise(0.0))
    q = F.array(*(F.lit(1.0 if x >= 0 else 0.0) for x in query_vector(spark, d)))
    return table(spark, d, "embeddings").select("vec_id", vectors.binary_distance("hamming", signs, q).cast("int").alias("hamming"), F.round(vectors.binary_distance("jaccard", signs, q), 6).alias("jaccard"))


def _order_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Comparison of sparse and of bit vectors: each row's with the next row's."""
    a = table(spark, d, "embeddings").select("vec_id", sparse_column(_v()).alias("s"), quantize.binary_quantize(_v()).alias("b"))
    n = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"), F.col("b").alias("c"))
    return a.join(n, "vec_id").select("vec_id", sparse.compare(F.col("s"), F.col("s")).alias("self"), (sparse.compare(F.col("s"), F.col("t")) == -sparse.compare(F.col("t"), F.col("s"))).alias("turned"), vectors.compare(F.col("b"), F.col("c")).alias("bits"))

def sparse_column(v: Column) -> Column:
    """The values of at least CUT in size."""
    return sparse.from_vector(F.transform(v, lambda x: F.when(F.abs(x) >= CUT, x).otherwise(F.lit(0.0).cast("float"))))


def sparse_query(spark: SparkSession, d: str, i: int = 0) -> sparse.Sparse:
    return sparse.literal([x if abs(x) >= CUT else 0.0 for x in query_vector(spark, d, i)])


def _sparse_distances(spark: SparkSession, d: str) -> DataFrame:
    q = sparse_query(spark, d)
    s = F.col("s")
    rows = table(spark, d, "embeddings").select("vec_id", sparse_column(_v()).alias("s")).where(F.size("s.indices") > 0)
    return rows.select(
        "vec_id", F.size("s.indices").alias("entries"), F.round(sparse.l2_distance(s, q), 6).alias("l2"), F.round(sparse.l1_distance(s, q), 6).alias("l1"),
        F.round(sparse.inner_product(s, q), 6).alias("ip"), F.round(sparse.cosine_distance(s, q), 6).alias("cosine"), sparse.dims(s).alias("dims"),
        (sparse.to_vector(sparse.parse(sparse.to_text(s))) == sparse.to_vector(s)).alias("same"),
    )


def _bit_distances(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(x >= 0) for x in query_vector(spark, d)))
    b = quantize.binary_quantize(_v())
    return table(spark, d, "embeddings").select("vec_id", bits.hamming_distance(b, q).alias("hamming"), F.round(bits.jaccard_distance(b, q), 6).alias("jaccard"), bits.to_text(b).alias("bits"))


def _vector_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregates.aggregate_vectors(table(spark, d, "embeddings"), ["label"], "embedding", "avg", DIMS)
    return rows.select("label", F.posexplode("value").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def _vector_sum(spark: SparkSession, d: str) -> DataFrame:
    """Without a given dimension."""
    rows = aggregates.aggregate_vectors(table(spark, d, "embeddings"), ["label"], "embedding", "sum")
    return rows.select("label", F.posexplode("value").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def _sparse_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", sparse_column(_v()).alias("s"))
    rows = aggregates.aggregate_sparse(rows, ["label"], "s", "sum")
    zipped = F.explode(F.arrays_zip(F.col("value.indices").alias("i"), F.col("value.values").alias("x"))).alias("e")
    return rows.select("label", zipped).select("label", F.col("e.i").alias("pos"), F.round(F.col("e.x").cast("double"), 4).alias("x"))


def _bit_or_and(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", quantize.binary_quantize(F.slice(_v(), 1, 8)).alias("b"))
    either, every = (aggregates.aggregate_bits(rows, ["label"], "b", how, 8) for how in ("or", "and"))
    return either.select("label", bits.to_text(F.col("value")).alias("any_bits")).join(every.select("label", bits.to_text(F.col("value")).alias("all_bits")), "label")


def _scalar_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = quantize.scalar_quantize(_v(), -0.5, 0.5, 16)
    back = quantize.scalar_reconstruct(codes, -0.5, 0.5, 16)
    total = F.aggregate(codes, F.lit(0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", total.alias("code_sum"), F.round(F.get(back, F.lit(0)).cast("double"), 6).alias("first"))


_BOOKS = [[[-0.1, -0.1], [0.1, 0.1], [-0.1, 0.1], [0.1, -0.1]]] * 32


def _product_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = quantize.product_quantize(_v(), 2, _BOOKS)
    back = quantize.product_reconstruct(codes, 2, _BOOKS)
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(codes, F.lit(0), lambda s, x: s + x).alias("code_sum"), F.round(F.get(back, F.lit(1)).cast("double"), 6).alias("second"))


def _scalar_range(spark: SparkSession, d: str) -> DataFrame:
    low, high = quantize.train_scalar(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")


def _max_sim(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as four tokens of 16 values, against two query tokens."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(_v(), i * 16 + 1, 16))
    q = query_vector(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), late.max_sim(tokens, [q[:16], q[16:32]]).alias("score"))
    return search.top(rows, 10, descending=True, keep=("point_id", "score")).select("point_id", F.round("score", 6).alias("score"))


def _usable() -> Column:
    return (F.size("token_vector") == 48) & F.forall("token_vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.forall("token_vector", lambda x: x.isNotNull())


def _max_sim_tokens(spark: SparkSession, d: str) -> DataFrame:
    """All points of a token table, by hash aggregation."""
    rows = table(spark, d, "late_interaction_tokens").where(_usable())
    scored = late.max_sim_rows(rows, "point_id", "token_vector", [[1.0] + [0.0] * 47, [0.0, 1.0] + [0.0] * 46, [0.1] * 48])
    return scored.select("point_id", F.round("score", 6).alias("score"))


QUERIES = {
    "vector_distances": _distances, "vector_pair_distances": _pair_distances, "vector_sql_functions": _sql_functions, "sql_families": _sql_families, "vector_text_form": _text_form, "half_rounding": _half, "half_avg": _half_avg, "sparse_avg": _sparse_avg, "binary_numeric": _binary_numeric, "order_of_kinds": _order_of_kinds,
    "sparse_distances": _sparse_distances, "bit_distances": _bit_distances, "vector_avg": _vector_avg, "vector_sum": _vector_sum, "sparse_sum": _sparse_sum, "bit_or_and": _bit_or_and,
    "scalar_codes": _scalar_codes, "product_codes": _product_codes, "scalar_range": _scalar_range, "max_sim": _max_sim, "max_sim_tokens": _max_sim_tokens,
}


def q_sql(i: int = 0) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i})"


_E = "embedding::DOUBLE[]"
_CUT = f"list_transform({_E}, lambda x: CASE WHEN abs(x) >= {CUT} THEN x ELSE 0 END)"
_CUTQ = f"(SELECT {_CUT} FROM embeddings WHERE vec_id = 0)"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"


_UNIT = "greatest(floor(log2(abs({0}))), -14) - 10"
_HALF = f"list_transform({_E}, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, {_UNIT.format('x')}), 0) * pow(2, {_UNIT.format('x')}) END)"
_UNNEST = "SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings"
_PQ = "list_transform(generate_series(0, 31), lambda i: CASE WHEN {e}[2*i+1] >= 0 AND {e}[2*i+2] >= 0 AND NOT ({e}[2*i+1] = 0 AND {e}[2*i+2] = 0) THEN 1 WHEN {e}[2*i+1] < 0 AND {e}[2*i+2] < 0 THEN 0 WHEN {e}[2*i+1] < 0 THEN 2 ELSE 3 END)"
SQL = {
    "vector_distances": f"""SELECT vec_id, len(embedding)::INT AS dims, round(list_distance({_E}, q), 6) AS l2, round({l1(_E, "q")}, 6) AS l1,
        round(list_inner_product({_E}, q), 6) AS ip, round(-list_inner_product({_E}, q), 6) AS nip, round(list_cosine_distance({_E}, q), 6) AS cosine FROM embeddings, (SELECT {q_sql()} AS q)""",
    "vector_pair_distances": """SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
        CASE WHEN a.embedding < b.embedding THEN -1 WHEN a.embedding > b.embedding THEN 1 ELSE 0 END AS cmp, a.embedding < b.embedding AS lt, a.embedding = b.embedding AS eq
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "vector_sql_functions": f"""SELECT vec_id, round(list_distance({_E}, q), 6) AS l2, round(list_inner_product({_E}, q), 6) AS ip, round(list_cosine_distance({_E}, q), 6) AS cosine, len(embedding)::INT AS dims
        FROM embeddings, (SELECT {q_sql(1)} AS q)""",
    "sql_families": f"""SELECT vec_id, round(list_distance(s, q), 6) AS l2, round({l1("s", "q")}, 6) AS l1, round(list_inner_product(s, q), 6) AS ip, round(list_cosine_distance(s, q), 6) AS cosine,
        len(list_filter(s, lambda x: x <> 0))::INT AS entries, round(list_sum(s), 5) AS total, CASE WHEN b < c THEN -1 WHEN b > c THEN 1 ELSE 0 END AS cmp, len(list_filter(b, lambda x: x))::INT AS ones, round(list_sum(h), 6) AS half_total
        FROM (SELECT vec_id, {_CUT} AS s, list_transform({_E}, lambda x: x >= 0) AS b, {_HALF} AS h FROM embeddings), (SELECT {_CUTQ} AS q, (SELECT list_transform({_E}, lambda x: x >= 0) FROM embeddings WHERE vec_id = 0) AS c)
        WHERE len(list_filter(s, lambda x: x <> 0)) > 0""",
    "vector_text_form": f"SELECT vec_id, round(list_sum({_E}), 6) AS total, embedding[64]::DOUBLE AS last, len(embedding)::INT AS dims FROM embeddings",
    "half_rounding": f"""SELECT vec_id, h[1] AS first, round(list_sum(h), 6) AS total, round(list_distance(h, list_transform(h, lambda x: 0.0999755859375::DOUBLE)), 6) AS l2
        FROM (SELECT vec_id, {_HALF} AS h FROM embeddings)""",
    "half_avg": f"""SELECT label, count(*)::INT AS dims, round(sum(CASE WHEN m = 0 THEN 0 ELSE round_even(m / pow(2, {_UNIT.format("m")}), 0) * pow(2, {_UNIT.format("m")}) END), 2) AS total FROM (
        SELECT label, pos, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest({_HALF}) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1""",
    "sparse_avg": f"SELECT label, (pos + 1)::INT AS pos, round((sum(x) / any_value(n))::FLOAT::DOUBLE, 4) + 0 AS x FROM ({_UNNEST}) JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label) WHERE abs(x) >= {CUT} GROUP BY 1, 2 HAVING sum(x) <> 0",
    "binary_numeric": f"""SELECT vec_id, len(list_filter(list_zip(b, q), lambda p: p[1] <> p[2]))::INT AS hamming,
        round(1 - len(list_filter(list_zip(b, q), lambda p: p[1] AND p[2])) / len(list_filter(list_zip(b, q), lambda p: p[1] OR p[2])), 6) AS jaccard
        FROM (SELECT vec_id, list_transform({_E}, lambda x: x >= 0) AS b FROM embeddings), (SELECT list_transform({_E}, lambda x: x >= 0) AS q FROM embeddings WHERE vec_id = 0)""",
    "order_of_kinds": f"""SELECT a.vec_id, 0 AS self, TRUE AS turned, CASE WHEN a.b < b.b THEN -1 WHEN a.b > b.b THEN 1 ELSE 0 END AS bits FROM (SELECT vec_id, list_transform({_E}, lambda x: x >= 0) AS b FROM embeddings) a
        JOIN (SELECT vec_id, list_transform({_E}, lambda x: x >= 0) AS b FROM embeddings) b ON b.vec_id = a.vec_id + 1""",
    "sparse_distances": f"""SELECT vec_id, len(list_filter(s, lambda x: x <> 0))::INT AS entries, round(list_distance(s, q), 6) AS l2, round({l1("s", "q")}, 6) AS l1, round(list_inner_product(s, q), 6) AS ip,
        round(list_cosine_distance(s, q), 6) AS cosine, 64 AS dims, TRUE AS same FROM (SELECT vec_id, {_CUT} AS s FROM embeddings), (SELECT {_CUTQ} AS q) WHERE len(list_filter(s, lambda x: x <> 0)) > 0""",
    "bit_distances": f"""SELECT vec_id, len(list_filter(list_zip(b, q), lambda p: p[1] <> p[2]))::INT AS hamming,
        round(1 - len(list_filter(list_zip(b, q), lambda p: p[1] AND p[2])) / len(list_filter(list_zip(b, q), lambda p: p[1] OR p[2])), 6) AS jaccard,
        array_to_string(list_transform(b, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS bits
        FROM (SELECT vec_id, list_transform({_E}, lambda x: x >= 0) AS b FROM embeddings), (SELECT list_transform({_E}, lambda x: x >= 0) AS q FROM embeddings WHERE vec_id = 0)""",
    "vector_avg": f"SELECT label, pos::INT AS pos, round(avg(x), 6) AS x FROM ({_UNNEST}) GROUP BY 1, 2",
    "vector_sum": f"SELECT label, pos::INT AS pos, round(sum(x), 6) AS x FROM ({_UNNEST}) GROUP BY 1, 2",
    "sparse_sum": f"SELECT label, (pos + 1)::INT AS pos, round(sum(x)::FLOAT::DOUBLE, 4) AS x FROM ({_UNNEST}) WHERE abs(x) >= {CUT} GROUP BY 1, 2 HAVING sum(x) <> 0",
    "bit_or_and": """SELECT label, string_agg(any_b, '' ORDER BY pos) AS any_bits, string_agg(all_b, '' ORDER BY pos) AS all_bits FROM (
        SELECT label, pos, CASE WHEN bool_or(x >= 0) THEN '1' ELSE '0' END AS any_b, CASE WHEN bool_and(x >= 0) THEN '1' ELSE '0' END AS all_b FROM (
        SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) WHERE pos <= 8 GROUP BY 1, 2) GROUP BY 1""",
    "scalar_codes": f"""SELECT vec_id, list_sum(c)::INT AS code_sum, round((-0.5::DOUBLE + c[1] * (1.0::DOUBLE / 15))::FLOAT::DOUBLE, 6) AS first FROM (
        SELECT vec_id, list_transform({_E}, lambda x: floor((least(greatest(x, -0.5), 0.5) + 0.5) * 15 + 0.5)::INT) AS c FROM embeddings)""",
    "product_codes": f"""SELECT vec_id, list_sum(c)::INT AS code_sum, CASE WHEN c[1] IN (1, 2) THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS second FROM (SELECT vec_id, {_PQ.format(e="embedding")} AS c FROM embeddings)""",
    "scalar_range": "SELECT round(min(list_min(embedding))::DOUBLE, 6) AS low, round(max(list_max(embedding))::DOUBLE, 6) AS high FROM embeddings",
    "max_sim": f"""SELECT vec_id AS point_id, round(s, 6) AS score FROM (SELECT vec_id, list_max(list_transform([0, 16, 32, 48], lambda i: list_inner_product(({_E})[i+1:i+16], q[1:16])))
        + list_max(list_transform([0, 16, 32, 48], lambda i: list_inner_product(({_E})[i+1:i+16], q[17:32]))) AS s FROM embeddings, (SELECT {q_sql()} AS q)) ORDER BY s DESC, vec_id LIMIT 10""",
    "max_sim_tokens": """SELECT point_id, round(max(v[1]) + max(v[2]) + max(0.1 * list_sum(v)), 6) AS score FROM (
        SELECT point_id, token_vector::DOUBLE[] AS v FROM late_interaction_tokens WHERE len(token_vector) = 48) WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1""",
}
