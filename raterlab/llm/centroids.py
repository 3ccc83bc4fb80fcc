"""Centroid clustering in integers, with Ptolemy's inequality sparing distances.

For a vector x, a centroid c and pivots p and s Ptolemy's inequality gives
    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).
The pairs (p, s) are fixed: p is a centroid as it stood in some round, s one of PARTNERS points
far out (the first starting centroids, FAR times as long). Each vector caches its distances to all s, and for each
cluster its last exact distance together with the round p that it was measured in. A round bounds all distances
from the cache and measures exactly, in integers, the distance to its last centroid and to those
whose bound does not exceed it; these enter the cache. Cached distances are rounded to 32 bits, and every
bound takes the unfavourable end of the rounding and of the pivots' own distances, so no
centroid that may be nearest is ever left out, ties included.

State is one row per vector, rewritten each round to the shared checkpoint folder; what reaches the driver is one
row of sums per cluster.

Defined results: vectors that are null, have not exactly ``dims`` components, or hold a null or non-finite one take no
part; components are floor(256 x), taken as at most 2 ** 27 in size (beyond, a squared distance would not
fit in 64 bits); repeated rows are vectors of their own; a null id is never among the starting centroids unless there are
too few others; with fewer than k vectors there are as many centroids; equal start digests go by components; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import drop_tables, scratch_table

K, ROUNDS, DIMS = 40, 5, 64
PARTNERS, FAR = 8, 4
LIMIT = 1 << 27
#: Relative error of a distance rounded to 32 bits, generously; of 64-bit arithmetic, very generously.
ROUNDED, SLACK = 2.0 ** -23, 1e-9
#: Vectors looked at together.
SLICE = 512
STATE = "vec_id long, v binary, far binary, near binary, since binary, cluster int, distance long, checked int"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * 256, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return df.filter(x.isNotNull() & (F.size(x) == dims) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _start_key(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)


def _pack(v: np.ndarray) -> list[bytes]:
    """Rows as bytes, 16-bit where all components of the row fit."""
    small = np.abs(v).max(1, initial=0) < 1 << 15
    return [r.astype("<i2" if s else "<i4").tobytes() for r, s in zip(v, small)]


def _unpack(rows: list[bytes], dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<i4") for r in rows]).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths between all rows of two small tables, as 64-bit floats."""
    d = a[:, None, :].astype(np.float64) - b[None, :, :]
    return np.sqrt((d * d).sum(-1))


class Pivots:
    """The centroids of all rounds so far, and what the bounds need of them."""

    def __init__(self, history: list[np.ndarray], partners: np.ndarray) -> None:
        self.now, self.partners = history[-1], partners
        past = np.stack(history)  # round, cluster, component
        self.moved = np.sqrt(((past - past[-1]).astype(np.float64) ** 2).sum(-1))
        self.apart = np.stack([_distances(h, partners) for h in past])  # d(p, s)
        self.out = _distances(past[-1], partners)  # d(c, s)

    def bounds(self, far: np.ndarray, near: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors to the centroids of now, from cached distances."""
        cluster = np.arange(near.shape[1])
        moved = self.moved[since, cluster]
        far, near = far.astype(np.float64), near.astype(np.float64)
        low, high = (1 - ROUNDED), (1 + ROUNDED)
        best = np.zeros(near.shape)
        for s in range(far.shape[1]):
            apart, out, x = self.apart[since, cluster, s], self.out[:, s], far[:, s:s + 1]
            one = (near * low) * (out * (1 - SLACK)) - (x * high) * (moved * (1 + SLACK))
            two = (x * low) * (moved * (1 - SLACK)) - (near * high) * (out * (1 + SLACK))
            bound = np.maximum(one, two) / np.where(apart > 0, apart * (1 + SLACK), np.inf)
            np.maximum(best, bound, out=best)
        return best

    def assign(self, v: np.ndarray, far: np.ndarray, near: np.ndarray, since: np.ndarray, last: np.ndarray, turn: int):
        """Nearest centroids (the smaller number of equally near ones) and exact squared distances; renews the cache."""
        rows = np.arange(len(v))
        own = v - self.now[last]
        most = (own * own).sum(1)
        look = (self.bounds(far, near, since) * (1 - SLACK)) ** 2 <= (most * (1 + SLACK))[:, None]
        look[rows, last] = True
        r, c = np.nonzero(look)
        gap = v[r] - self.now[c]
        exact = np.full(look.shape, np.iinfo(np.int64).max)
        exact[r, c] = (gap * gap).sum(1)
        near[r, c] = np.sqrt(exact[r, c])
        since[r, c] = turn
        cluster = exact.argmin(1)
        return cluster, exact[rows, cluster], look.sum(1)


def _assigned(state: DataFrame, pivots: Pivots, turn: int, dims: int) -> DataFrame:
    """The state after one more assignment; before the first (``turn`` 0) it has vectors alone and everything is measured."""
    k = len(pivots.now)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                n = part.num_rows
                if turn == 0:
                    v = np.array(part.column(1).flatten().to_numpy(), np.int64).reshape(n, dims)
                    packed = _pack(v)
                    gap = v[:, None, :] - pivots.partners[None]
                    far = np.sqrt((gap.astype(np.float64) ** 2).sum(-1)).astype(np.float32)
                    near, since, last = np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8), np.zeros(n, np.int64)
                else:
                    packed = part.column(1).to_pylist()
                    v = _unpack(packed, dims)
                    far, near = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.float32).reshape(n, -1).copy() for i in (2, 3))
                    since = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(n, k).copy()
                    last = part.column(5).to_numpy().astype(np.int64)
                cluster, distance, checked = pivots.assign(v, far, near, since, last, turn)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in far], pa.binary()),
                     pa.array([x.tobytes() for x in near], pa.binary()), pa.array([x.tobytes() for x in since], pa.binary()),
                     pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(checked, pa.int32())],
                    names=[f.split()[0] for f in STATE.split(", ")])
    return scratch_table(state.mapInArrow(run, STATE), "centroids")


def _moved(state: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after an assignment: each task sums its vectors by cluster, one row per cluster reaches the driver."""
    k = len(centroids)

    def run(batches):
        import pyarrow as pa
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                cluster = part.column(0).to_numpy()
                np.add.at(sums, cluster, _unpack(part.column(1).to_pylist(), dims))
                counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(held)), pa.int32()),
             pa.array(np.concatenate([counts[held, None], sums[held]], axis=1).ravel(), pa.int64())], names=["cluster", "at", "amount"])
    cells = state.select("cluster", "v").mapInArrow(run, "cluster int, at int, amount long")
    # k * (dims + 1) numbers
    cells = cells.groupBy("cluster", "at").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
    total = {(c, a): int(n) for c, a, n in cells}
    return np.array([[total[c, a] // total[c, -1] for a in range(dims)] if (c, -1) in total else list(old)
                     for c, old in enumerate(centroids)], np.int64).reshape(k, dims)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
                    dims: int = DIMS, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, checked, cluster_inertia, inertia, centroid_sha256) per vector that takes part; ``checked``
    is the number of distances measured for it in the last assignment."""
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vector_col, dims)
    start = rows.select(_start_key(seed).alias("key"), "vec_id", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    final = "vec_id long, cluster int, distance long, checked int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], final)
    history = [np.array([r.v for r in start], np.int64).reshape(len(start), dims)]
    partners = history[0][:PARTNERS] * FAR + 1  # off the origin, should a centroid lie there
    state = _assigned(rows, Pivots(history, partners), 0, dims)
    for turn in range(1, rounds + 1):
        history.append(_moved(state, history[-1], dims))
        after = _assigned(state, Pivots(history, partners), turn, dims)
        drop_tables(state)
        state = after
    per = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = sum(int(r.s) for r in per)
    most = (1 << 63) - 1
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    facts = spark.createDataFrame([(r.cluster, min(int(r.s), most), min(inertia, most), digests[r.cluster]) for r in per],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(*[f.split()[0] for f in final.split(", ")])
