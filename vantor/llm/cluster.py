"""Clusters of mutually similar vectors by Gaussian mixtures.

Vectors of length one are standardised and reduced to their leading principal components, both from moments over all
rows. Coarse mixtures with equal weights and one shared covariance, on two levels, deal the rows out into parts that fit a
task, each row to one part: the first level is fitted by distributed expectation-maximisation over all rows, the second
by the executors, each cell of the first from a sample of its own rows. Within a part, a mixture of spherical, regularised components and one broad background
component starts at the peaks of density and sheds the components that an information criterion rejects. Components are
the clusters: a row belongs to its likeliest one, and a check verifies it against the component's representative, the member of highest
density. Components of different parts whose representatives are as similar as members are one, and rows that no component of their
own part holds are offered to those of others; both by a search among the representatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.knn import fit_centroids, nearest, unit, unpack
from vantor.llm.topn import top_n
from vantor.runtime import discard, folded, materialize

THRESHOLD, TYPICAL = 0.85, 5
#: Rows of a part, about; dimensions after the reduction; rows on which the coarse mixture is started (at least 8 per component); rounds of both mixtures.
PART_ROWS, REDUCED, START_ROWS, ROUNDS = 4_000, 24, 8_192, 6
#: Neighbours among the representatives that link clusters of different parts, and lists probed for them.
LINKS, PROBES = 16, 12
#: A part of more than so many times PART_ROWS is dealt out by a hash to several tasks; their components of one cluster become one like those of other parts.
OVERSIZED = 3
#: Rows of the second level's samples per part, about.
PART_SAMPLE = 48
#: Weight of the regularisation: a component's variance is drawn towards this share of the part's variance.
SHRINK, PRIOR = 0.05, 2.0
#: Rows of an E-step's block; components that a row is offered to, likeliest first.
STEP, NEXT = 2048, 4
_SUMMED = 32


def _summed(df: DataFrame, size: int, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a vector of `size` numbers per batch, added up on the executors down to a few rows."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    rows = df.mapInArrow(one, "x binary").repartition(_SUMMED).mapInArrow(more, "x binary").collect()  # _SUMMED rows
    return sum((np.frombuffer(bytes(r.x), np.float64) for r in rows), np.zeros(size))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def fit_reduction(rows: DataFrame, dim: int, reduced: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, projection) from the moments over all rows; the projection holds the correlation matrix's leading directions."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        u = _units(batch.column(0), dim).astype(np.float64)
        return np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])

    total = _summed(rows.select("u"), 1 + dim + dim * dim, moments)
    n = max(1.0, total[0])
    mean = total[1 : dim + 1] / n
    covariance = total[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-8))
    _, directions = np.linalg.eigh(covariance / np.outer(deviation, deviation))
    return mean, deviation, directions[:, ::-1][:, : min(reduced, dim)]


def _reduce(u: np.ndarray, reduction: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, deviation, projection = reduction
    return (((u - mean) / deviation) @ projection).astype(np.float32)


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T), 0)


def _hash_below(share: float) -> int:
    """The bound under which about this share of all 64-bit hashes lies."""
    return min((1 << 63) - 1, int(-(1 << 63) + min(1.0, share) * (1 << 64)))


def _cells(z: np.ndarray, count: int) -> np.ndarray:
    """Means to start from: the cells of directions around the middle."""
    middle = z.mean(0)
    length = np.linalg.norm(z - middle, axis=1, keepdims=True)
    turned = ((z - middle) / np.maximum(length, 1e-9)).astype(np.float32)
    cells = fit_centroids(turned, count)
    nearest = (turned @ cells.T).argmax(1)
    sums, held = np.zeros_like(cells), np.bincount(nearest, minlength=len(cells))
    np.add.at(sums, nearest, z)
    return np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], middle + cells * length.mean() * 0.1).astype(np.float32)


def _start_means(rows: DataFrame, dim: int, reduction: tuple[np.ndarray, ...], count: int, total: int) -> np.ndarray:
    """Cells of a bounded sample, the rows with the smallest hashes; others are filtered out before they meet in one task."""
    wanted = max(START_ROWS, 8 * count)
    start = rows.where(F.col("h2") <= _hash_below(2.0 * wanted / max(1, total))).orderBy("h2").limit(wanted).select("u").collect()
    return _cells(_reduce(np.frombuffer(b"".join(bytes(r.u) for r in start), np.float32).reshape(-1, dim), reduction), count)


def fit_coarse(rows: DataFrame, dim: int, reduction: tuple[np.ndarray, ...], means: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(means, rows nearest to each) after so many rounds of expectation-maximisation over all rows; the shared variance starts from the first round's distances."""
    width, variance, nearest = means.shape[1], None, np.zeros(len(means))
    for _ in range(rounds):

        def step(batch: pa.RecordBatch, means: np.ndarray = means, variance: float | None = variance) -> np.ndarray:
            z = _reduce(_units(batch.column(0), dim), reduction)
            d = _square_distances(z, means)
            least = d.min(1, keepdims=True)
            r = np.exp(-(d - least) / (2 * (variance or max(1e-6, float(least.mean()) / width))))
            r /= r.sum(1, keepdims=True)
            count = np.bincount(d.argmin(1), minlength=len(means))
            return np.concatenate([r.sum(0), (r.T @ z).ravel(), count, [(r * d).sum(), len(z)]])

        k = len(means)
        total = _summed(rows.select("u"), k + k * width + k + 2, step)
        weight, sums, nearest = total[:k], total[k : k + k * width].reshape(k, width), total[k + k * width : -2]
        means = np.where(weight[:, None] > 1e-6, sums / np.maximum(weight, 1e-6)[:, None], means).astype(np.float32)
        variance = max(float(total[-2] / (width * max(1.0, total[-1]))), 1e-6)
    return means, nearest


def fit_parts(rows: DataFrame, dim: int, reduction: tuple[np.ndarray, ...], means: np.ndarray, counts: np.ndarray, total: int) -> list[np.ndarray]:
    """For each cell of the first level the means of its parts, counts of them, fitted by the executors on a sample of about PART_SAMPLE rows per part."""
    width = means.shape[1]

    def of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _square_distances(_reduce(_units(batch.column(0), dim), reduction), means).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0)], ["cell", "u"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        data = pa.Table.from_batches(whole)
        cells = data["cell"].to_numpy()
        for c in np.unique(cells):
            own = sorted(data.filter(pa.array(cells == c))["u"].to_pylist())  # whatever order the shuffle brings
            found = _cells(_reduce(np.frombuffer(b"".join(own), np.float32).reshape(-1, dim), reduction), int(counts[c]))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([found.astype(np.float32).tobytes()], pa.binary())], ["cell", "means"])

    sample = rows.where(F.col("h2") <= _hash_below(max(PART_SAMPLE * float(counts.sum()), START_ROWS) / max(1, total))).select("u")
    found = sample.mapInArrow(of_cell, "cell int, u binary").repartitionById(len(means), F.col("cell")).mapInArrow(one, "cell int, means binary").collect()  # one row per cell
    out = [m[None] for m in means]
    for r in found:
        out[r.cell] = np.frombuffer(bytes(r.means), np.float32).reshape(-1, width)
    return out


class Mixture:
    """Spherical components with regularised variances, and one broad background component, which comes last."""

    def __init__(self, z: np.ndarray, seeds: np.ndarray) -> None:
        self.wide_mean, self.wide = z.mean(0), np.maximum(z.var(0), 1e-6)
        self.goal, k = SHRINK * float(self.wide.mean()), len(seeds)
        self.means, self.var = z[seeds].astype(np.float64), np.full(k, self.goal * 2)
        self.weight = np.full(k + 1, 0.5 / max(1, k))
        self.weight[-1] = 0.5

    def logs(self, z: np.ndarray) -> np.ndarray:
        """Log-density of each row under each component, weighted (rows x components)."""
        width = z.shape[1]
        back = -0.5 * (((z - self.wide_mean) ** 2 / self.wide).sum(1) + np.log(self.wide).sum() + width * math.log(2 * math.pi))
        own = -0.5 * (_square_distances(z, self.means.astype(np.float32)) / self.var + width * np.log(2 * math.pi * self.var)) if len(self.means) else np.zeros((len(z), 0))
        return np.concatenate([own, back[:, None]], axis=1) + np.log(self.weight)

    def round(self, z: np.ndarray) -> np.ndarray:
        """One round of expectation-maximisation; returns what each component adds to the log-likelihood beyond what the others say of its rows, and its mass."""
        k, width = self.means.shape
        sums, mass, spread, gain = np.zeros_like(self.means), np.zeros(k + 1), np.zeros(k), np.zeros(k)
        for at in range(0, len(z), STEP):
            x = z[at : at + STEP]
            logs = self.logs(x)
            r = np.exp(logs - logs.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            mass += r.sum(0)
            sums += r[:, :k].T @ x
            spread += (r[:, :k] * _square_distances(x, self.means.astype(np.float32))).sum(0)
            gain += -np.log1p(-np.minimum(r[:, :k], 1 - 1e-12)).sum(0) if k else 0.0
        held = np.maximum(mass[:k], 1e-9)
        fresh = sums / held[:, None]
        moved = ((fresh - self.means) ** 2).sum(1)
        self.var = (np.maximum(spread - held * moved, 0) + PRIOR * width * self.goal) / (width * (held + PRIOR))
        self.means, self.weight = fresh, np.maximum(mass, 1e-3) / (mass.sum() + 1e-3 * k)
        return np.stack([gain, mass[:k]])

    def keep(self, kept: np.ndarray) -> None:
        self.means, self.var = self.means[kept], self.var[kept]
        self.weight = self.weight[np.append(kept, True)]
        self.weight /= self.weight.sum()


def density_peaks(z: np.ndarray, radius2: float) -> np.ndarray:
    """Rows that seed components, densest first: each has a neighbour within the radius and no denser seed there."""
    counts = np.concatenate([(_square_distances(z[i : i + 2048], z) <= radius2).sum(1) for i in range(0, len(z), 2048)]) if len(z) else np.zeros(0, int)
    seeds, free = [], counts > 1
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 2:
            break
        if free[i]:
            seeds.append(i)
            free &= ((z - z[i]) ** 2).sum(1) > radius2
    return np.array(seeds, np.int64)


def choose_mixture(z: np.ndarray, radius2: float, rounds: int = ROUNDS) -> Mixture:
    """The mixture that starts at all peaks of density and sheds the components that the information criterion rejects.

    A component's parameters count by the rows that determine them: it stays if it adds more than (width + 2) / 2 * log(rows
    of its own) to the log-likelihood. What is left is fitted on.
    """
    mixture = Mixture(z, density_peaks(z, radius2))
    for half in range(2):
        gain, mass = np.zeros(0), np.zeros(0)
        for _ in range(rounds if len(mixture.means) else 0):
            gain, mass = mixture.round(z)
        if not half and len(gain):
            mixture.keep(gain > (z.shape[1] + 2) / 2 * np.log(np.maximum(mass, 2.0)))
    return mixture


def component_clusters(z: np.ndarray, u: np.ndarray, radius2: float, threshold: float, fit: Callable[[np.ndarray, float], Mixture] = choose_mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, component, log-density) of each row of a part; a cluster is named by the position of its representative, rows in none by -1.

    Clusters are the components: a row belongs to its likeliest one, and the row of highest density represents it. A check
    verifies the members against the representative; a row that fails it is offered to its next likely components, and
    what no component holds is fitted again by a mixture of its own as long as that finds components. Components
    whose representatives are as similar as members are one.
    """
    n = len(z)
    cluster, component, density = np.full(n, -1), np.full(n, -1), np.full(n, -np.inf)
    left, named = np.arange(n), 0
    while len(left) > 1:
        mixture = fit(z[left], radius2)
        k = len(mixture.means)
        if not k:
            break
        x, own = z[left], u[left]
        near = np.empty((len(left), min(NEXT, k)), np.int64)
        alone, logs_of, total = np.zeros(len(left), bool), np.empty((len(left), near.shape[1])), np.empty(len(left))
        for at in range(0, len(left), STEP):
            logs = mixture.logs(x[at : at + STEP])
            first = np.argpartition(-logs[:, :k], near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            first = np.take_along_axis(first, np.argsort(-np.take_along_axis(logs, first, 1), axis=1, kind="stable"), 1)
            near[at : at + STEP], logs_of[at : at + STEP] = first, np.take_along_axis(logs, first, 1)
            alone[at : at + STEP] = logs[:, k] > logs_of[at : at + STEP, 0]
            top = logs.max(1)
            total[at : at + STEP] = top + np.log(np.exp(logs - top[:, None]).sum(1))
        # the representative: of the rows most likely of the component the densest
        order = np.lexsort((np.arange(len(left)), -logs_of[:, 0], near[:, 0]))
        order = order[~alone[order]]
        begin = np.concatenate([[True], near[order, 0][1:] != near[order, 0][:-1]]) if len(order) else np.zeros(0, bool)
        lead = np.full(k, -1)
        lead[near[order[begin], 0]] = order[begin]
        home = np.full(len(left), -1)
        for j in range(near.shape[1]):
            go = np.nonzero((home < 0) & (lead[near[:, j]] >= 0))[0]
            with_lead = lead[near[go, j]]
            go = go[np.einsum("ij,ij->i", own[go], own[with_lead]) >= threshold]
            home[go] = near[go, j]
        count = np.bincount(home[home >= 0], minlength=k)
        held = (home >= 0) & (count[np.maximum(home, 0)] > 1)
        if not held.any():
            break
        cluster[left[held]] = left[lead[home[held]]]
        component[left[held]], density[left[held]] = named + home[held], total[held]
        density[left[~held]] = np.maximum(density[left[~held]], total[~held])
        left, named = left[~held], named + k
    leads = np.unique(cluster[cluster >= 0])
    if len(leads):
        same = _linked(u[leads], threshold, leads)
        where = np.arange(n)
        where[leads] = same
        cluster = np.where(cluster >= 0, where[np.maximum(cluster, 0)], -1)
    return cluster, component, np.where(np.isfinite(density), density, 0.0)


def _linked(u: np.ndarray, threshold: float, label: np.ndarray) -> np.ndarray:
    """Labels of representatives after merging those that are at least so similar, the smallest label of each connected set."""
    left, right = [], []
    for at in range(0, len(u), 2048):
        i, j = np.nonzero(u[at : at + 2048] @ u.T >= threshold)
        go = i + at < j
        left.append(i[go] + at)
        right.append(j[go])
    a, b = np.concatenate([*left, np.zeros(0, int)]), np.concatenate([*right, np.zeros(0, int)])
    label = label.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    return label


def find_clusters(df: DataFrame, key: str, vector: str, dim: int, threshold: float = THRESHOLD, part_rows: int = PART_ROWS, reduced: int = REDUCED) -> DataFrame:
    """Rows (key, cluster, component, density): every usable key with its cluster (the smallest key of its members).

    component names the mixture component ("part/component", null for a row that only the background holds), density is the log-density under the part's
    mixture, relative to other rows of the part. Unusable vectors (null, wrong length, null or non-finite values, all zero) and null keys are left out.
    Repeated rows of a key count once; of different vectors of one key that of the smallest hash holds. Exact copies are clustered once
    and get their cluster together. An empty table has no clusters. Other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.size("v") == dim).select("key", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = unpack(batch.column(1), dim)
            u = [x.tobytes() for x in unit(vectors)] if len(vectors) else []
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(u, pa.binary()), batch.column(2).take(take), batch.column(3).take(take)], ["key", "u", "h1", "h2"])

    usable = rows.mapInArrow(scaled, f"key {kind}, u binary, h1 bigint, h2 bigint")
    usable = usable.groupBy("h1", "h2", "key").agg(F.first("u").alias("u"))
    one = materialize(usable, "units")
    names = one.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("h")).select("key", "h.h1", "h.h2")
    distinct = materialize(one.join(names, ["key", "h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("key").alias("key"), F.first("u").alias("u")), "distinct")
    total = distinct.count()
    schema = f"key {kind}, cluster {kind}, component string, density double"
    if not total:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    reduction = fit_reduction(distinct, dim, reduced)
    count = max(1, math.ceil(total / part_rows))
    means, parts = np.zeros((1, min(reduced, dim)), np.float32), [np.zeros((1, min(reduced, dim)), np.float32)]
    if count > 1:
        means, cells = fit_coarse(distinct, dim, reduction, _start_means(distinct, dim, reduction, math.ceil(math.sqrt(count)), total))
        parts = fit_parts(distinct, dim, reduction, means, np.maximum(1, np.ceil(cells / part_rows)).astype(np.int64), total)
    first_of = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)

    def part_of(u: np.ndarray) -> np.ndarray:
        z = _reduce(u, reduction)
        cell, out = _square_distances(z, means).argmin(1), np.zeros(len(z), np.int64)
        for c in np.unique(cell):
            mine = np.nonzero(cell == c)[0]
            out[mine] = first_of[c] + _square_distances(z[mine], parts[c]).argmin(1)
        return out

    count = sum(len(p) for p in parts)
    sizes = _summed(distinct.select("u"), count, lambda batch: np.bincount(part_of(_units(batch.column(0), dim)), minlength=count).astype(float)) if count > 1 else np.array([total])
    pieces = np.maximum(1, np.ceil(sizes / (OVERSIZED * part_rows))).astype(np.int64)
    begins, count = np.cumsum(pieces) - pieces, int(pieces.sum())
    radius2 = float(2 * (1 - threshold) * (1 / reduction[1] ** 2).mean() * means.shape[1] / dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = part_of(_units(batch.column(1), dim))
            part = begins[own] + (batch.column(2).to_numpy() >> 7) % pieces[own]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), batch.column(1)], ["part", "key", "u"])

    def mixtures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        data = pa.Table.from_batches(whole).sort_by("key")
        parts = data["part"].to_numpy()
        for p in np.unique(parts):
            mine = data.filter(pa.array(parts == p))
            u = _units(mine["u"], dim)
            cluster, component, density = component_clusters(_reduce(u, reduction), u, radius2, threshold)
            held = cluster >= 0
            cluster = np.where(held, cluster, np.arange(len(u)))
            smallest = np.full(len(u), len(u))
            np.minimum.at(smallest, cluster, np.arange(len(u)))  # rows are sorted by key
            keys = mine["key"].combine_chunks()
            named = pa.array([f"{p}/{c}" if c >= 0 else None for c in component.tolist()], pa.string())
            # representatives, and rows without a component, take part in the search across parts
            leads = cluster == np.arange(len(u))
            vectors = pa.array([x if y else None for x, y in zip(list(u), leads.tolist(), strict=True)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([keys, keys.take(pa.array(smallest[cluster])), named, pa.array(density), vectors, pa.array(held)], ["key", "cluster", "component", "density", "lead", "held"])

    dealt = distinct.select("key", "u", "h1").mapInArrow(deal, f"part int, key {kind}, u binary").repartitionById(count, F.col("part"))
    found = materialize(dealt.mapInArrow(mixtures, schema + ", lead array<float>, held boolean"), "mixtures")
    own = found.drop("lead", "held")
    if count > 1:
        own = _across_parts(found.where(F.col("lead").isNotNull()).select("cluster", "lead", "held"), own, dim, threshold)
    own = own.join(distinct.select("key", "h1", "h2"), "key").select("cluster", "component", "density", "h1", "h2")
    return names.join(own, ["h1", "h2"]).select(F.col("key").alias(key), "cluster", "component", "density")


def _across_parts(leads: DataFrame, members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """members with the components of different parts that are one under one name, and with rows that had none in the component that holds them.

    Only representatives of components are searched. As long as some lead has as many similar ones as are searched for, there may be more: then the search is
    repeated with one representative of each merged cluster.
    """
    while True:
        found = nearest(leads, "cluster", "lead", dim, k=LINKS, floor=threshold, probes=PROBES, indexed=F.col("held")).select(F.col("key_a").alias("cluster"), F.col("key_b").alias("low"))
        links = materialize(found, "links")
        most = links.groupBy("cluster").count().agg(F.max("count")).first()[0]
        if most is None:
            return members
        labels = merge_linked(links)
        members = materialize(members.join(labels, "cluster", "left").withColumn("cluster", F.coalesce("label", "cluster")).drop("label"), "members")
        if most < LINKS:
            return members
        leads = materialize(leads.join(labels.where(F.col("label") != F.col("cluster")), "cluster", "left_anti"), "leads")


def merge_linked(links: DataFrame) -> DataFrame:
    """Rows (cluster, label) for clusters with links (cluster, low): the smallest name in each connected set.

    Each round a link's two ends take the smaller of their labels, until nothing changes; as the members of a set are
    linked nearly all with each other, that takes a few rounds. Links and labels stay distributed.
    """
    both = links.unionByName(links.select(F.col("low").alias("cluster"), F.col("cluster").alias("low")))
    labels = materialize(both.groupBy("cluster").agg(F.least(F.min("low"), F.col("cluster")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("cluster").alias("low"), F.col("label").alias("theirs")), "low").groupBy("cluster").agg(F.min("theirs").alias("theirs"))
        fresh = labels.join(around, "cluster").select("cluster", F.least("label", "theirs").alias("label"), (F.col("theirs") < F.col("label")).alias("moved"))
        fresh, old = materialize(fresh, "labels"), labels
        discard(old)
        labels = fresh.select("cluster", "label")
        if fresh.where("moved").isEmpty():
            return labels


def group_pairs(clusters: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Rows (id_a, id_b): in each cluster of at least so many members, its smallest key with each other member."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cluster")
    return clusters.join(sizes, "cluster", "left_semi").where(F.col(key) != F.col("cluster")).select(F.col("cluster").alias("id_a"), F.col(key).alias("id_b"))


def describe(clusters: DataFrame, records: DataFrame, key: str, category: str, least: int = 2, typical: int = TYPICAL) -> DataFrame:
    """Rows (cluster, size, typical, category) for clusters of at least `least` members.

    typical: the keys of highest density, densest first; category: the most frequent one among the members (without
    regard to letter case and surrounding space, the first by name among equals), null if no member has one.
    """
    clusters = materialize(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    best = top_n(clusters, "cluster", key, "density", typical).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", F.col(key).alias("k")))).alias("t"))
    named = records.select(F.col(key), folded(F.col(category)).alias("category")).where(F.col("category") != "").dropDuplicates([key, "category"])
    often = clusters.join(named, key).groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    often = often.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("c"))
    out = sizes.join(best, "cluster").join(often, "cluster", "left")
    return out.select("cluster", "size", F.col("t.k").alias("typical"), F.col("c.category").alias("category"))
