"""Near-duplicate vectors by product quantisation over inverted lists.

A coarse quantiser (k-means on a bounded sample) assigns each unit vector to a list; its
residual is coded per subspace. A vector visits its own list and those lower-numbered lists
whose Voronoi border is within the threshold's radius: a neighbour in another list lies beyond
that border, so no probe that could find a link is left out, whatever the vectors' geometry.
In a list, an asymmetric table lookup gives the distance from the visitor to each
member's reconstruction; the member's own quantisation error turns it into a lower bound, so
no true neighbour is dropped there. Survivors are ranked by exact cosine in double precision.
Vectors of different dimensions are never alike; each dimension has quantisers of its own.
Equal vectors of one label form a class first: one of them is compared, and counts as many
times as the class has members, so a hot group of copies costs no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.components import block_components, connected_components
from segflow.llm.staging import discard, stage
from segflow.llm.wordhash import lean

#: Vectors that the quantisers are fitted on, about (shared among the dimensions); vectors of one label in a list, on average; lists at most.
SAMPLE, PER_LIST, MAX_LISTS = 16_384, 256, 2048
SUBSPACES, CODES = 8, 256
#: Members and visitors that meet in one task.
CHUNK = 1024

_VISITS = "label string, dim int, list int, side int, vec_id long, copies long, vector binary, code binary, error float"


@dataclass
class Quantiser:
    """Coarse centres [lists, dim] and codewords [subspaces, codes, dim / subspaces]."""

    centres: np.ndarray
    words: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(x, self.centres)
        return d.argmin(1), d

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norm of what they miss."""
        parts = residual.reshape(len(residual), len(self.words), -1)
        codes = np.stack([squared(parts[:, m], w).argmin(1) for m, w in enumerate(self.words)], 1).astype(np.uint8)
        rebuilt = np.stack([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        return codes, np.sqrt(((parts - rebuilt) ** 2).sum((1, 2)))

    def table(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each subspace of each residual to each codeword: [n, subspaces, codes]."""
        parts = residual.reshape(len(residual), len(self.words), -1)
        return np.stack([squared(parts[:, m], w) for m, w in enumerate(self.words)], 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    dim = sample.shape[1]
    while dim % subspaces:
        subspaces -= 1
    centres = kmeans(sample, min(lists, len(sample)), 8, 1)
    residual = (sample - centres[squared(sample, centres).argmin(1)]).reshape(len(sample), subspaces, -1)
    words = np.stack([kmeans(residual[:, m], min(codes, len(sample)), 6, 2 + m) for m in range(subspaces)])
    return Quantiser(centres, words)


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _visit(fitted: dict[int, Quantiser], radius: float, deviations: float | None, kind: str) -> Callable:
    gaps = {dim: np.sqrt(squared(q.centres, q.centres)) for dim, q in fitted.items()}

    def visits(part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        q, border = fitted[dim], 1e-9 + (radius if deviations is None else min(radius, deviations * radius / math.sqrt(dim)))
        x = _unit(np.frombuffer(b"".join(part.column(1).to_pylist()), kind).astype(np.float64).reshape(len(part), dim))
        home, d = q.nearest(x)
        codes, error = q.encode(x - q.centres[home])
        own = d[np.arange(len(x)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            drift = (d - own[:, None]) / (2 * gaps[dim][home])
        near = np.where(np.isfinite(drift), drift <= border, d <= own[:, None])
        near &= np.arange(len(q.centres))[None, :] <= home[:, None]
        near[np.arange(len(x)), home] = False
        who, where = np.nonzero(near)
        rows = np.concatenate([np.arange(len(x)), who])
        side = np.concatenate([np.zeros(len(x), np.int32), np.ones(len(who), np.int32)])
        n = len(x)
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [
                part.column(2).take(take),
                pa.array(np.full(len(rows), dim, np.int32)),
                pa.array(np.concatenate([home, where]).astype(np.int32)),
                pa.array(side),
                part.column(0).take(take),
                part.column(4).take(take),
                part.column(1).take(take),
                pa.array([codes[i].tobytes() if k < n else None for k, i in enumerate(rows.tolist())], pa.binary()),
                pa.array(np.where(side == 0, error[rows], 0).astype(np.float32)),
            ],
            ["label", "dim", "list", "side", "vec_id", "copies", "vector", "code", "error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                dims = part.column(3).to_numpy()
                for dim in np.unique(dims).tolist():
                    yield visits(part.filter(pa.array(dims == dim)), dim)

    return run


def _match(fitted: dict[int, Quantiser], threshold: float, radius: float, kind: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        q = fitted[table.column("dim")[0].as_py()]
        ids = table.column("vec_id").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        x = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).astype(np.float64).reshape(len(ids), -1))
        members = np.flatnonzero(side == 0)
        visitors = np.flatnonzero(side != 0)
        cell = table.column("list")[0].as_py()
        count = np.zeros(len(ids), np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(members) and len(visitors):
            codes = np.frombuffer(b"".join(table.column("code").take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
            error = table.column("error").to_numpy()[members]
            for lo in range(0, len(visitors), 128):
                asked = visitors[lo : lo + 128]
                tables = q.table(x[asked] - q.centres[cell])
                total = np.zeros((len(asked), len(members)))
                for m in range(codes.shape[1]):
                    total += tables[:, m, :].take(codes[:, m], axis=1)
                near = np.sqrt(total) - error[None, :] <= radius + 1e-5
                v, j = np.nonzero(near)
                v, j = asked[v], members[j]
                fit = (ids[j] != ids[v]) & ((side[v] != 2) | (ids[j] > ids[v]))  # a member visiting its own list meets each pair once
                v, j = v[fit], j[fit]
                for at in range(0, len(v), 1 << 16):
                    p, r = v[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    good = (x[p] * x[r]).sum(1) >= threshold
                    left.append(p[good])
                    right.append(r[good])
        a, b = np.concatenate(left), np.concatenate(right)
        np.add.at(count, a, copies[b])
        np.add.at(count, b, copies[a])
        root = block_components(len(ids), a, b)
        got = np.flatnonzero(count)
        return pa.table({"vec_id": ids[got], "n": count[got], "root": ids[root[got]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, deviations: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Vectors are compared within equal labels. A vector that is null or zero, holds null or
    non-finite components, or has a null label or id, links with nothing; nor do vectors of
    different dimensions. Rows that share a vec_id count as one vector: the first by
    label and components stands for it, and each row is returned. A null id has a null
    component and is not kept. Empty input: empty result.

    No link is lost. ``deviations`` trades that for fewer probes: lists are then visited only if
    their border is within so many standard deviations of a random displacement of the
    radius's length, which misses links of vectors that vary in few directions.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    whole = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("e", lambda c: c != 0)
    valid = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    every_id = stage(valid.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("x")).select("vec_id", "x.label", "x.e"), "vectors")
    # a class of equal vectors is compared once, as its least id, and counts as often as it has members
    one = stage(every_id.groupBy("label", "e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("dim", F.size("e")), "classes")
    empty = v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # for each dimension, the vectors that a vector shares its label with, on average: lists are as many as these ask for
    sizes = one.groupBy("dim", "label").agg(F.count("*").cast("double").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("alike")).collect()
    if not sizes:
        return empty
    # a share of each dimension's vectors by a hash of their ids, so that about as many as asked for come to the driver
    most = max(1, SAMPLE // len(sizes))
    taken = F.lit(False)
    for dim, n, _ in sizes:
        taken = taken | ((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))))
    sample = one.filter(taken).select("dim", "e").toPandas()
    fitted = {}
    for dim, _, alike in sizes:
        own = np.array(sample["e"][sample["dim"] == dim].tolist(), np.float64).reshape(-1, dim)
        fitted[dim] = fit(_unit(own) if len(own) else np.zeros((1, dim)), max(1, min(MAX_LISTS, int(alike) // PER_LIST)))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    # vectors of floats travel as such; all arithmetic is in doubles
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(1, "vector", pa.array([np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()], pa.binary()))

    packed = one.select("vec_id", "e", "label", "dim", "copies").mapInArrow(to_bytes, "vec_id long, vector binary, label string, dim int, copies long")
    visits = stage(packed.mapInArrow(lean(_visit(fitted, radius, deviations, kind)), _VISITS), "visits")
    # chunks of members x chunks of visitors; members also visit their own list
    chunks = lambda k: F.greatest(F.lit(1), F.ceil(k / CHUNK)).cast("int")
    sizes_ = stage(visits.groupBy("label", "dim", "list").agg(chunks(F.sum((F.col("side") == 0).cast("int"))).alias("n_met"), chunks(F.count("*")).alias("n_own")), "sizes")
    placed = visits.join(sizes_, ["label", "dim", "list"])
    dealt = lambda n: F.expr(f"cast(pmod(xxhash64(vec_id), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    fields = ["vec_id", "copies", "vector", "code", "error"]
    as_member = placed.filter("side = 0").select("label", "dim", "list", dealt("n_met").alias("met"), every("n_own").alias("own"), F.lit(0).alias("side"), *fields)
    as_visitor = placed.select("label", "dim", "list", every("n_met").alias("met"), dealt("n_own").alias("own"), F.when(F.col("side") == 0, 2).otherwise(1).alias("side"), *fields)
    found = stage(as_member.unionByName(as_visitor).groupBy("label", "dim", "list", "met", "own").applyInArrow(_match(fitted, threshold, radius, kind), "vec_id long, n long, root long"), "matches")
    discard(visits, sizes_)
    counts_ = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    # what each class found, and its members; staged, so that the rows of a hot class may be split
    many = one.filter("copies > 1").select("label", "e", F.col("vec_id").alias("first"), "copies")
    members = stage(every_id.join(many, ["label", "e"]).select("vec_id", "first", "copies"), "members")
    linked = stage(comps.join(counts_, F.col("node") == F.col("vec_id")).select(F.col("node").alias("first"), "component", "n"), "linked")
    discard(every_id, one, found)
    rows = stage(v.select("vec_id").join(members, "vec_id", "left").withColumn("first", F.coalesce("first", "vec_id")), "rows")
    out = rows.join(linked, "first", "left")
    component = F.coalesce("component", "first")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
