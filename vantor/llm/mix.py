"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.bpe import TOKENIZERS, count_tokens
from vantor.runtime import folded, materialize

#: Hash buckets of the correction, and the seed of all hashes.
BUCKETS, SEED = 4096, 7
_U = float(1 << 63)


def truncated_poisson(mean: float, most: int) -> list[float]:
    """Cumulative probabilities of 0..most for a Poisson variable cut off at `most`, its rate chosen so that the mean is as given."""
    if mean <= 0:
        return [1.0] * (most + 1)
    if mean >= most:
        return [0.0] * most + [1.0]

    def weights(rate: float) -> list[float]:
        logs = [i * math.log(rate) - math.lgamma(i + 1) for i in range(most + 1)]
        top = max(logs)
        raw = [math.exp(x - top) for x in logs]
        return [x / sum(raw) for x in raw]

    low, high = 1e-12, 1e12
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if sum(i * w for i, w in enumerate(weights(mid))) < mean else (low, mid)
    total, out = 0.0, []
    for w in weights(low):
        total += w
        out.append(min(total, 1.0))
    out[-1] = 1.0
    return out


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, key, target_share, max_repeats, tokens, corpus_tokens, wanted, rate.

    sizes: rows (key, n_tokens), key being the folded source, null for documents without one. corpus_tokens covers all
    documents, listed source or not. rate is the mean number of copies of a document, at most max_repeats. Targets without documents have 0
    tokens; targets with a null source, share or repeats are left out. Of targets that fold to one source, the first by name holds.
    """
    by_source = materialize(sizes.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")  # the corpus is read once
    total = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    wanted = targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull())
    wanted = wanted.select(folded(F.col("source")).alias("key"), F.struct("source", "target_share", "max_repeats").alias("t"))
    wanted = wanted.groupBy("key").agg(F.min("t").alias("t")).select("key", "t.*")
    plan = wanted.join(by_source, "key", "left").crossJoin(F.broadcast(total))  # the total is one row
    tokens, want = F.coalesce("tokens", F.lit(0)), F.col("target_share") * F.col("corpus_tokens")
    return plan.select(
        "source", "key", "target_share", "max_repeats", tokens.alias("tokens"), "corpus_tokens", want.alias("wanted"),
        F.least(F.when(tokens > 0, want / tokens).otherwise(0.0), F.col("max_repeats").cast("double")).alias("rate"),
    )


def _sized(documents: DataFrame, directory: str, text: bool) -> DataFrame:
    """The table (doc_id, key, n_tokens), with the texts if wanted, one row per document; null texts have 0 tokens. The tokens are counted once."""
    rows = documents.select("doc_id", folded(F.col("source")).alias("key"), F.col("text").cast("string").alias("text"))
    return materialize(count_tokens(rows, ["doc_id", "key", *(["text"] if text else [])], "text", directory), "sized")


def _drawn(sized: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, list[tuple]]:
    """sized with source and the number of copies n of each document that enters the mix, and the rows of the report.

    What decides on n besides hashes of doc_id is a few rows per target, which are broadcast; documents aren't shuffled.
    """
    spark = sized.sparkSession
    plan = source_plan(sized, targets).collect()  # one row per target
    draws = [(r.key, r.source, int(r.max_repeats), truncated_poisson(float(r.rate), int(r.max_repeats))) for r in plan if r.max_repeats >= 0]
    table = spark.createDataFrame(draws, "key string, source string, max_repeats int, cumulative array<double>")
    u = (F.xxhash64(F.lit(seed), "doc_id") / F.lit(_U) + 1) / 2
    second = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(BUCKETS)).cast("int")
    drawn = sized.where(F.col("n_tokens") > 0).join(F.broadcast(table), "key")
    drawn = drawn.withColumn("bucket", second).withColumn("n", F.least(F.size(F.filter("cumulative", lambda c: c <= u)), F.col("max_repeats"))).drop("cumulative")
    sums = drawn.groupBy("key", "bucket").agg(
        F.sum(F.col("n") * F.col("n_tokens")).alias("drawn"),
        F.sum(F.when(F.col("n") < F.col("max_repeats"), F.col("n_tokens")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("n_tokens")).otherwise(0)).alias("fewer"),
    ).collect()  # at most BUCKETS rows per target
    by_key: dict[str, list] = {}
    for s in sums:
        by_key.setdefault(s.key, []).append(s)
    turns, reached = [], {}
    for r in plan:
        own = sorted(by_key.get(r.key, ()), key=lambda s: s.bucket)
        first = sum(s.drawn for s in own)
        off = min(float(r.wanted), float(r.tokens) * max(0, r.max_repeats)) - first
        step = 1 if off > 0 else -1
        below, done = 0, 0
        for s in own:
            gain = s.more if step > 0 else s.fewer
            if abs(abs(off) - done - gain) >= abs(abs(off) - done) and gain:
                break
            done, below = done + gain, s.bucket + 1
        turns.append((r.key, step, below))
        reached[r.key] = int(first + step * done)
    turned = spark.createDataFrame(turns, "key string, step int, below int")
    final = F.when(F.col("bucket") < F.col("below"), F.least(F.greatest(F.col("n") + F.col("step"), F.lit(0)), F.col("max_repeats"))).otherwise(F.col("n"))
    drawn = drawn.join(F.broadcast(turned), "key").withColumn("n", final).where(F.col("n") > 0).drop("bucket", "step", "below", "max_repeats")
    total = sum(reached.values())
    report = [
        (r.source, float(r.target_share), int(r.max_repeats), int(r.tokens), float(r.wanted), reached[r.key], reached[r.key] / total if total else 0.0, int(total), reached[r.key] >= int(r.tokens) * int(r.max_repeats))
        for r in plan
    ]
    return drawn, report


def mix(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZERS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: rows (doc_id, source, copy, n_tokens, text, order_key), one per copy, dealt out by order_key, which is a hash, and sorted by it
    within each partition: a global shuffle, the only one of the texts. A document's number of copies comes from its hash through the inverse of a Poisson
    distribution cut off at max_repeats, whose mean is the source's rate. As such draws miss the target by the
    luck of the hash, a correction follows: in each source, documents whose second hash lies below a threshold get one
    copy more (or one fewer), the threshold being found from exact token sums by hash bucket over the whole source.

    Report: per target source, target_share, max_repeats, tokens, wanted_tokens, actual_tokens, actual_share, mix_tokens,
    exhausted (every document is used max_repeats times).

    Documents with null or unlisted source count towards the corpus and don't enter the mix; documents without tokens
    (null or empty text) don't enter it either. Repeated rows of a doc_id are drawn alike, each row for itself. Targets
    that can't be met are filled with max_repeats copies of each document. Empty documents give an empty mix.
    """
    drawn, report = _drawn(_sized(documents, directory, True), targets, seed)
    copies = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "n_tokens", "text")
    copies = copies.withColumn("order_key", F.xxhash64(F.lit(seed + 2), "doc_id", "copy"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "order_key").sortWithinPartitions("order_key"), _report(documents, report)


_REPORT = "source string, target_share double, max_repeats int, tokens bigint, wanted_tokens double, actual_tokens bigint, actual_share double, mix_tokens bigint, exhausted boolean"


def _report(documents: DataFrame, rows: list[tuple]) -> DataFrame:
    return documents.sparkSession.createDataFrame(rows, _REPORT)  # one row per target


def shares(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZERS, seed: int = SEED) -> DataFrame:
    """The mix's report alone: the draws are made, the texts stay where they are."""
    return _report(documents, _drawn(_sized(documents, directory, False), targets, seed)[1])


def unreachable(report: DataFrame) -> DataFrame:
    """Rows (source): targets of a mix that its draws left short of the wanted tokens with every document used max_repeats times."""
    return report.where((F.col("actual_tokens") < F.col("wanted_tokens")) & F.col("exhausted")).select("source")
