"""The k most similar vectors of every vector, by an adaptive dimension scan over probed lists.

Vectors are scaled to length one and rotated at random. Lists are the cells of centroids fitted on a bounded sample;
every vector is a member of its nearest list and probes the lists nearest to it. Lists that lie close together form a
group, and a group is what one task scans: a vector travels once to each group in which it is a member or probes. A group
of too many members or queries is cut into slices of either, each pair of which is a task of its own. Within
a list the scan takes the rotated columns in blocks. After each block a hypothesis test compares the partial
distance, scaled to all columns, with the query's present k-th distance, and abandons candidates that would need to be an
unlikely exception. What is left is scored exactly, in double precision, from the vectors as they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The index is fitted on at most SAMPLE_PER_LIST vectors per list, of at most MAX_LISTS lists; every vector is indexed.
SAMPLE_PER_LIST, MAX_LISTS = 32, 4096
#: Vectors of a group, about; columns of a block; the test's significance (the larger, the fewer wrong abandonments); near ties that are kept for the exact scores.
GROUP_ROWS, BLOCK, EPSILON, SLACK = 40_000, 16, 2.1, 8
#: Tasks that the queries of a table of at least so many rows each are dealt out to, at least.
LEAST_TASKS, TASK_ROWS = 6, 8_000
#: Groups of exact copies from this size on, and from a ten-thousandth of all rows on, are answered without the index.
HOT_COPIES = 64
#: A list is left out only if a neighbour in it would have to deviate by so many standard deviations from a random direction.
REACH = 4.0
SEED = 11


def unpack(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the usable vectors of a list column: exactly dim values, all finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    at = np.nonzero((np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False))[0]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # null values become NaN
    vectors = flat[offsets[at][:, None] + np.arange(dim)] if len(at) else np.empty((0, dim), np.float32)
    good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return at[good], vectors[good]


def unit(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    exact /= np.abs(exact).max(1, keepdims=True)  # so that the squares of very small or large values don't vanish or overflow
    return (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length one by spherical k-means over unit vectors; empty lists keep theirs."""
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def _different(units: np.ndarray) -> np.ndarray:
    """The first of each set of rows that are the same but for rounding, in their order."""
    return units[np.sort(np.unique(units.round(5) + 0.0, axis=0, return_index=True)[1])]


def group_lists(centroids: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The group of each list: the heaviest group is halved along its main direction until there are enough."""
    parts = [np.arange(len(centroids))]
    while len(parts) < groups:
        parts.sort(key=lambda p: (len(p) > 1, weight[p].sum()))
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        main = np.linalg.svd(centroids[p] - centroids[p].mean(0), full_matrices=False)[2][0]
        p = p[np.argsort(centroids[p] @ main, kind="stable")]
        load = np.cumsum(weight[p])
        cut = int(np.clip(np.searchsorted(load, load[-1] / 2), 1, len(p) - 1))
        parts += [p[:cut], p[cut:]]
    out = np.zeros(len(centroids), np.int32)
    for i, p in enumerate(parts):
        out[p] = i
    return out


def _pack(vectors: np.ndarray) -> pa.Array:
    """Vectors as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = vectors.astype(np.float16)
    fits = (half.astype(np.float32) == vectors).all(1)
    if fits.all():
        wide = vectors.shape[1] * 2
        offsets = (np.arange(len(vectors) + 1) * wide).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(half.tobytes())])
    return pa.array([half[i].tobytes() if fits[i] else vectors[i].tobytes() for i in range(len(vectors))], pa.binary())


def _unpack(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim), np.float32)
    short = np.array([len(b) == 2 * dim for b in raw], bool)
    if short.any():
        out[short] = np.frombuffer(b"".join(b for b in raw if len(b) == 2 * dim), np.float16).reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join(b for b in raw if len(b) == 4 * dim), np.float32).reshape(-1, dim)
    return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; the same for (a, b) and (b, a), and 1.0 for equal rows."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a /= np.abs(a).max(1, keepdims=True)
    b /= np.abs(b).max(1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return np.clip(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), -1.0, 1.0)


def _first(query: np.ndarray, value: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest (value, key) of each query, in the order of query, value and key."""
    order = np.lexsort((key, value, query))
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - begin < n]


def reach(floor: float, dim: int) -> float:
    """Lists whose centroids are at least this similar to a vector can hold vectors of similarity `floor` to it.

    A member at the angle b from a centroid, itself at the angle a from the vector, has the similarity cos a cos b +
    r sin a sin b, where r is the cosine of what both have beside the centroid: about 1 / sqrt(dim) as its standard
    deviation between unrelated directions. With r at REACH of those and the b that suits best, this is
    sqrt(cos² a + r² sin² a); below the floor, the list can't hold one.
    """
    r2 = REACH * REACH / dim
    return -1.0 if floor <= 0 or r2 >= floor * floor else math.sqrt((floor * floor - r2) / (1 - r2)) if floor < 1 else 1.0 - 1e-5


def scan(keys: np.ndarray, raw: np.ndarray, home: np.ndarray, probes: list[np.ndarray], k: int, floor: float | None, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity): keys of the k best members for each row that probes, over the lists of one group.

    home: each row's list, -1 for rows that only probe; probes: each row's lists, nearest first.
    """
    dim = raw.shape[1]
    rows = unit(raw) @ turn
    member_order = np.argsort(home, kind="stable")
    member_order = member_order[home[member_order] >= 0]
    lists, begin = np.unique(home[member_order], return_index=True)
    members = dict(zip(lists.tolist(), np.split(member_order, begin[1:]), strict=True)) if len(lists) else {}
    counts = np.array([len(p) for p in probes], np.int64)
    flat_query, flat_list = np.repeat(np.arange(len(keys)), counts), np.concatenate([*probes, np.zeros(0, np.int64)]).astype(np.int64)
    rank = np.arange(len(flat_query)) - np.repeat(np.cumsum(counts) - counts, counts)
    band = np.where(rank < 1, 0, 1 + np.log2(np.maximum(rank, 1)).astype(int) // 2)
    keep, widest = k + SLACK, 2.0 if floor is None else 2.0 - 2.0 * floor + 1e-5
    limit = np.full(len(keys), 4.0 if floor is None else widest)
    best_q, best_m, best_d = (np.zeros(0, t) for t in (np.int64, np.int64, np.float32))
    edges = [*range(BLOCK, dim, BLOCK), dim]
    slack = [(e / dim) * (1 + EPSILON / math.sqrt(e)) ** 2 if e < dim else 1.0 for e in edges]
    for b in range(int(band.max()) + 1 if len(band) else 0):
        chosen = np.nonzero(band == b)[0]
        chosen = chosen[np.argsort(flat_list[chosen], kind="stable")]
        parts, found = np.unique(flat_list[chosen], return_index=True), []
        for one, queries in zip(parts[0].tolist(), np.split(flat_query[chosen], parts[1][1:]), strict=True):
            m = members.get(one)
            if m is None:
                continue
            for at in range(0, len(queries), max(1, 4_000_000 // len(m))):
                q = queries[at : at + max(1, 4_000_000 // len(m))]
                first = slice(0, edges[0])
                partial = np.einsum("ij,ij->i", rows[q, first], rows[q, first])[:, None] + np.einsum("ij,ij->i", rows[m, first], rows[m, first])[None] - 2 * (rows[q, first] @ rows[m, first].T)
                i, j = np.nonzero(partial <= (limit[q] * slack[0] + 1e-5)[:, None])
                # where most pairs pass the first block, as within one dense spot, one product over all columns is cheaper than going on by pairs
                dense = len(i) > partial.size // 20
                if dense:
                    i, j = np.nonzero(2 - 2 * (rows[q] @ rows[m].T) <= (limit[q] + 2e-5)[:, None])
                i, j = q[i], m[j]
                other = keys[i] != keys[j]
                i, j = i[other], j[other]
                # columns beyond the first block, for those that are left; the first is added anew, by one way of adding for equal vectors
                got = np.zeros(len(i), np.float32)
                for e, (start, end, wide) in enumerate(zip([0, *edges[:-1]], edges, slack, strict=True)):
                    got += np.einsum("ij,ij->i", d := rows[i, start:end] - rows[j, start:end], d)
                    if e and (not dense or end == dim):
                        go = got <= limit[i] * wide + 1e-5
                        i, j, got = i[go], j[go], got[go]
                if len(i):
                    found.append((i, j, got))
                if sum(len(x[0]) for x in found) > 2_000_000:
                    best_q, best_m, best_d = _merge(keys, (best_q, best_m, best_d), found, keep, limit)
                    found = []
        if found:
            best_q, best_m, best_d = _merge(keys, (best_q, best_m, best_d), found, keep, limit)
    similarity = exact_cosine(raw[best_q], raw[best_m]) if len(best_q) else np.zeros(0)
    if floor is not None:
        good = similarity >= floor
        best_q, best_m, similarity = best_q[good], best_m[good], similarity[good]
    top = _first(keys[best_q], -similarity, keys[best_m], k + SLACK)
    return keys[best_q[top]], keys[best_m[top]], similarity[top]


def _merge(keys: np.ndarray, best: tuple[np.ndarray, ...], found: list[tuple[np.ndarray, ...]], keep: int, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best so far and what was found, cut to the first `keep` of each query; limit falls to the last kept distance."""
    q, m, d = (np.concatenate(x) for x in zip(best, *found, strict=True))
    # of repeated rows of a neighbour's key one counts
    order = np.lexsort((d, keys[m], q))
    same = np.concatenate([[False], (q[order][1:] == q[order][:-1]) & (keys[m[order]][1:] == keys[m[order]][:-1])])
    order = order[~same]
    top = order[_first(q[order], d[order], keys[m[order]], keep)]
    q, m, d = q[top], m[top], d[top]
    full, count = np.unique(q, return_counts=True)
    last = np.cumsum(count) - 1
    done = count >= keep
    limit[full[done]] = np.minimum(limit[full[done]], d[last[done]])
    return q, m, d


def nearest(
    df: DataFrame, key: str, vector: str, dim: int, k: int = 5, floor: float | None = None, probes: int = 8,
    probe_share: float = 0.0, queries: Column | None = None, indexed: Column | None = None, hot_copies: int = HOT_COPIES, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows (key_a, key_b, similarity, place): the k most similar other keys of each key, by cosine, then smaller key.

    floor: only neighbours of at least this similarity; the scan then abandons the more. queries: a condition that
    says for which rows neighbours are wanted (all by default), against all rows. indexed: a condition that says which rows
    can be neighbours (all by default). probes: lists probed by a vector at
    least, and at least this share (probe_share) of all lists. With a floor, a vector also probes every further list
    within reach(floor, dim), however many a dense spot has. With a floor and neither condition, what one vector finds also
    counts for the other, so a pair is missed only if both miss it.

    Unusable vectors (null, other lengths, null or non-finite values, all zero) and null keys are left out. Repeated
    rows of a key count once; a key with different vectors is as similar as the most similar of them. Of exact copies
    beyond the hot limit only the k + 1 smallest keys are indexed, as no other can be among anyone's first k; each of
    the rest has the first k of them as neighbours. Tables with fewer than two usable vectors give no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    member = F.lit(True) if indexed is None else F.coalesce(indexed, F.lit(False))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"), asked.alias("asked"), member.alias("member"))
    counts = (F.count_if("member"), F.count_if(F.col("member") & _usable(dim)), F.approx_count_distinct(F.when(F.col("member") & _usable(dim), F.xxhash64("v"))), F.count_if("asked"))
    every, total, distinct, asking = rows.agg(*counts).first()
    schema = f"key_a {kind}, key_b {kind}, similarity double, place int"
    if total < (2 if indexed is None else 1):
        return spark.createDataFrame([], schema)
    lists = max(1, min(MAX_LISTS, int(math.sqrt(total))))
    bound = lists * SAMPLE_PER_LIST

    hot_from = max(hot_copies, every // 10_000)
    counted = rows.where("member").groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_from)
    hot = counted.select("h").collect()  # at most 10,000 rows
    direct = None
    if hot:
        hashes = F.broadcast(spark.createDataFrame(hot, "h bigint"))
        rows = rows.withColumn("h", F.xxhash64("v"))
        rows, direct = _without_hot(rows, hashes, dim, k, floor)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, vectors = unpack(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in unit(vectors)] if len(vectors) else [], pa.binary())], ["u"])

    # a bounded sample: the different usable vectors with the smallest hashes, a few more than needed as the count is rough. Copies
    # would take up lists of their own, all at one place, and a vector near it would spend its probes on them
    part = min(1.0, 2.0 * bound / max(1, distinct))
    drawn = rows.where("member").select("v", F.xxhash64("v").alias("h")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + part * (1 << 64)))))
    drawn = drawn.where(_usable(dim)).dropDuplicates(["h"]).orderBy("h").limit(bound).select("v")
    sample = np.array([np.frombuffer(bytes(r.u), np.float32) for r in drawn.mapInArrow(take, "u binary").collect()], np.float32).reshape(-1, dim)  # at most `bound` rows
    sample = _different(sample)  # vectors of one direction can have different lengths
    centroids = _different(fit_centroids(sample, lists))
    lists = len(centroids)
    weight = np.bincount((sample @ centroids.T).argmax(1), minlength=lists)
    groups = max(1, min(lists, round(every / group_rows)))
    group_of = group_lists(centroids, weight, groups)
    probing = min(lists, max(probes, math.ceil(probe_share * lists)))
    within = None if floor is None else reach(floor, dim)
    turn = rotation(dim)

    def probed_lists(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own list, which lists are probed, similarity to the centroids with the sign turned) of each vector."""
        near = -(units @ centroids.T)
        own = near.argmin(1).astype(np.int32)
        probed = np.full(near.shape, probing >= lists) if within is None or probing >= lists else near <= -within
        probed[np.arange(len(near)), own] = True  # also where others are equally near
        if probing < lists:
            np.put_along_axis(probed, np.argpartition(near, probing - 1, axis=1)[:, :probing], True, axis=1)
        return own, probed, near

    # how many members and queries a group will have, out of the sample, and the slices that bound them
    visits = np.zeros(groups)
    for at in range(0, len(sample), 4096):
        probed = probed_lists(sample[at : at + 4096])[1]
        for g in range(groups):
            visits[g] += probed[:, group_of == g].any(1).sum()
    held = np.bincount(group_of, weight, groups) / len(sample) * every
    visits *= asking / len(sample)
    member_slices = np.maximum(1, np.ceil(held / (2 * group_rows))).astype(np.int64)
    query_slices = np.maximum(np.ceil(visits / (4 * group_rows)), np.minimum(math.ceil(LEAST_TASKS / groups), np.ceil(visits / TASK_ROWS)))
    query_slices = np.maximum(1, query_slices).astype(np.int64)
    first_task = np.concatenate([[0], np.cumsum(member_slices * query_slices)])
    tasks, most_slices = int(first_task[-1]), (int(member_slices.max()), int(query_slices.max()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                place, vectors = unpack(part.column(1), dim)
                if not len(place):
                    continue
                asks, member = (part.column(i).to_numpy(zero_copy_only=False)[place].astype(bool) for i in (2, 3))
                own, probed, near = probed_lists(unit(vectors))
                n, cut = np.nonzero(probed & asks[:, None])
                order = np.lexsort((cut, near[n, cut], n))
                n, cut = n[order], cut[order].astype(np.uint16)
                # one entry per vector and group that it probes, or its own group alone where no neighbours are wanted
                entry = n * groups + group_of[cut]
                order = np.argsort(entry, kind="stable")  # keeps the nearest list first
                entry, first = np.unique(entry[order], return_index=True)
                silent = np.nonzero(~asks & member)[0]
                vec = np.concatenate([entry // groups, silent])
                grp = np.concatenate([entry % groups, group_of[own[silent]]]).astype(np.int32)
                offsets = np.concatenate([first, np.full(len(silent) + 1, cut.size)]).astype(np.int32) * 2
                lists_of = pa.Array.from_buffers(pa.binary(), len(vec), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cut[order].tobytes())])
                home = np.where((group_of[own[vec]] == grp) & member[vec], own[vec], -1).astype(np.int32)
                keys, packed, asks_here = part.column(0).take(pa.array(place[vec])), _pack(vectors).take(pa.array(vec)), np.arange(len(vec)) < len(entry)
                mine = part.column(4).to_numpy()[place][vec]  # a hash of the key, so that equal keys stay together
                i, j = mine % member_slices[grp], (mine >> 20) % query_slices[grp]
                empty = pa.array([b""], pa.binary())

                def sent(chosen: np.ndarray, task: np.ndarray, member: bool, asks: np.ndarray, keys=keys, packed=packed, home=home, lists_of=lists_of) -> pa.RecordBatch:
                    probes_of = lists_of.take(pa.array(chosen)) if asks.all() else pa.chunked_array([lists_of, empty]).take(pa.array(np.where(asks, chosen, len(lists_of)))).combine_chunks()
                    probes_of = probes_of.chunk(0) if isinstance(probes_of, pa.ChunkedArray) else probes_of
                    of = pa.array(home[chosen] if member else np.full(len(chosen), -1, np.int32))
                    return pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), keys.take(pa.array(chosen)), of, probes_of, packed.take(pa.array(chosen))], ["grp", "key", "home", "probes", "raw"])

                start = first_task[grp]
                for slice_ in range(most_slices[1]):  # members meet every slice of the queries
                    go = np.nonzero((home >= 0) & (slice_ < query_slices[grp]))[0]
                    if len(go):
                        yield sent(go, (start + i * query_slices[grp] + slice_)[go], True, (asks_here & (j == slice_))[go])
                for slice_ in range(most_slices[0]):  # and queries every slice of the members, their own if they come as members being done
                    go = np.nonzero(asks_here & (slice_ < member_slices[grp]) & ~((home >= 0) & (i == slice_)))[0]
                    if len(go):
                        yield sent(go, (start + slice_ * query_slices[grp] + j)[go], False, np.ones(len(go), bool))

    mirrored = floor is not None and queries is None and indexed is None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        data = pa.Table.from_batches(whole)
        group_column = data["grp"].to_numpy()
        for g in np.unique(group_column):  # one, unless the partitions are fewer than the groups
            mine = data.filter(pa.array(group_column == g))
            probes_of = [np.frombuffer(p, np.uint16).astype(np.int64) for p in mine["probes"].to_pylist()]
            names = mine["key"].combine_chunks()
            number = np.unique(np.asarray(names.to_numpy(zero_copy_only=False)), return_inverse=True)  # places keep the order of the keys
            a, b, s = scan(number[1].astype(np.int64), _unpack(mine["raw"].to_pylist(), dim), mine["home"].to_numpy(), probes_of, k, floor, turn)
            distinct = pa.array(number[0], names.type)
            yield pa.RecordBatch.from_arrays([distinct.take(pa.array(a)), distinct.take(pa.array(b)), pa.array(s, pa.float64())], ["key_a", "key_b", "similarity"])

    assigned = rows.select("key", "v", "asked", "member", F.pmod(F.xxhash64("key"), F.lit(1 << 40)).alias("slice")).mapInArrow(assign, f"grp int, key {kind}, home int, probes binary, raw binary")
    pairs = assigned.repartitionById(tasks, F.col("grp")).mapInArrow(search, f"key_a {kind}, key_b {kind}, similarity double")
    if mirrored:
        both = F.explode(F.array(F.struct("key_a", "key_b", "similarity"), F.struct(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "similarity")))
        pairs = pairs.select(both.alias("p")).select("p.*")
    pairs = pairs.groupBy("key_a", "key_b").agg(F.max("similarity").alias("similarity"))
    if direct is not None:
        pairs = pairs.unionByName(direct)
    order = Window.partitionBy("key_a").orderBy(F.desc("similarity"), F.asc("key_b"))
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _usable(dim: int) -> Column:
    """As unpack() has it."""
    return (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)


def _without_hot(rows: DataFrame, hashes: DataFrame, dim: int, k: int, floor: float | None) -> tuple[DataFrame, DataFrame]:
    """rows without the copies that the index doesn't need, and the neighbours of those copies (key_a, key_b, similarity)."""
    hot = rows.join(hashes, "h", "left_semi").where(_usable(dim)).groupBy("h", "key").agg(F.max("asked").alias("asked"), F.max("member").alias("member"))
    salted = hot.where("member").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for part in (["h", "salt"], ["h"]):  # first within salts, so that no task holds a whole group
        salted = salted.withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy("key"))).where(F.col("rn") <= k + 1)
    leaders = salted.select("h", "key").groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("leaders"))  # at most 10,000 rows of k + 1 keys
    leaders = F.broadcast(leaders)
    known = rows.join(leaders, "h", "left")
    kept = known.where(F.col("leaders").isNull() | F.array_contains("leaders", F.col("key"))).select("key", "v", "asked", "member")
    rest = hot.join(leaders, "h").where(~F.array_contains("leaders", F.col("key")) & F.col("asked"))
    direct = rest.select(F.col("key").alias("key_a"), F.explode(F.slice("leaders", 1, k)).alias("key_b"), F.lit(1.0).alias("similarity"))
    return kept, direct if floor is None else direct.where(F.lit(floor) <= 1.0)


def similar_pairs(neighbours: DataFrame, field: str) -> DataFrame:
    """Rows (field, key_a, key_b), the smaller key first, of the pairs of which one is among the other's neighbours."""
    low, high = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
    return neighbours.select(F.lit(field).alias("field"), low.alias("key_a"), high.alias("key_b")).dropDuplicates(["key_a", "key_b"])
