"""Exact top-k by inner product: norm buckets, coordinate or length pruning, verified products.

Vectors become integers, floor(256 x). They are grouped by length into bands (a factor of
2 ** 0.25 each) and cut into blocks, sorted by length; queries are cut into blocks too. A
first pass against the longest block gives every query a score that its k-th best cannot
fall below (its floor). Block pairs whose lengths cannot reach the floors of a query block, whose queries are
of like length, are never joined. In a pair, the floor over the query's and the block's greatest length is the
cosine that a candidate must reach (the local threshold). Where it is negligible, candidates are bounded by
their length alone. Elsewhere they are bounded by their product with the query's largest coordinates plus the
product of what remains of both lengths; the lower the threshold, the more coordinates. Candidates
are verified by their integer products from the highest bound on; the floor rises with what is found, and the
first bound below it ends the block.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part, nor do rows without an id; shorter vectors count as padded with zeros; an empty
vector scores 0; ties go to the smaller id; of repeated rows each is a candidate (and, if
its id is one, a query) of its own, and only the query's own row is left out; products are
64-bit integers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlab.llm.common import scratch_table

BLOCK, QUERY_BLOCK = 1024, 256
#: Local threshold from which coordinates are looked at; least and greatest share of them; products at a time.
COORDINATE_FROM, COORDINATES, STEP = 0.02, (0.2, 0.5), 32
SLACK = 1e-9
PACKED = "block long, n long, dims long, longest double, rows binary, ids binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v, norm) of the rows that take part."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.filter(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                                  F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return scratch_table(rows.withColumn("norm", F.sqrt(square)), "vectors")


def _blocks(rows: DataFrame, size: int, key: list[str]) -> DataFrame:
    """Rows packed into blocks of about ``size`` vectors per value of ``key``, longest first."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("cuts"))
    # one row per length band, some hundred at most
    cut = rows.join(F.broadcast(counts), key).withColumn("cut", F.pmod(F.xxhash64("row"), F.col("cuts")))

    def pack(table):
        import pyarrow as pa
        order = np.argsort(-table.column("norm").to_numpy(), kind="stable")
        vectors = [table.column("v")[int(i)].values.to_numpy() for i in order]
        dims = max(map(len, vectors))
        packed = np.zeros((len(vectors), dims), np.int64)
        for r, v in zip(packed, vectors):
            r[:len(v)] = v
        norms = table.column("norm").to_numpy()
        return pa.table({"block": [0], "n": [len(vectors)], "dims": [dims], "longest": [float(norms[order[0]])],
                         "rows": [table.column("row").to_numpy()[order].tobytes()],
                         "ids": [table.column("vec_id").to_numpy()[order].tobytes()], "vectors": [packed.tobytes()]})
    made = cut.select(*key, "cut", "row", "vec_id", "v", "norm").groupBy(*key, "cut").applyInArrow(pack, PACKED)
    return scratch_table(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _unpack(n: int, dims: int, rows: bytes, ids: bytes, vectors: bytes, width: int):
    v = np.frombuffer(vectors, np.int64).reshape(n, dims)
    if width > dims:
        v = np.pad(v, ((0, 0), (0, width - dims)))
    return np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), v


def _bounds(query: np.ndarray, q_norm: float, floor: float, real: np.ndarray, squares: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of a block's vectors (longest first) with the query."""
    whole = q_norm * norms
    local = floor / whole[0] if whole[0] > 0 else 0.0
    if not local >= COORDINATE_FROM:
        return whole * (1 + SLACK)  # length pruning
    few, many = COORDINATES
    n = max(1, round(len(query) * min(many, max(few, 1 - local))))
    top = np.argpartition(-np.abs(query), min(n, len(query) - 1))[:n]
    left = np.sqrt(max(0.0, q_norm * q_norm - float((query[top] ** 2).sum())))
    rest = np.sqrt(np.maximum(0.0, norms * norms - squares[:, top].sum(1)))
    # the slack covers the rounding of lengths, squares and sums
    return real[:, top] @ query[top] + left * rest + whole * SLACK


def _nearest(query: np.ndarray, floor: float, k: int, own: np.ndarray, cs: np.ndarray, real, squares, norms) -> tuple:
    """Places and products of the candidates of a block that may be among the query's k best, how many were multiplied and the new floor."""
    q_real = query.astype(np.float64)
    q_norm = float(np.sqrt((q_real * q_real).sum()))
    places, scores, left = [], np.zeros(0, np.int64), np.flatnonzero(~own)
    bounds = None
    if floor > -np.inf:
        bounds = _bounds(q_real, q_norm, floor, real, squares, norms)
        left = left[np.argsort(-bounds[left], kind="stable")]
    while len(left):
        if bounds is None:  # nothing is known yet: the longest ones give a floor
            step, left = left[:STEP], left[STEP:]
        else:
            left = left[bounds[left] >= floor]
            step, left = left[:STEP], left[STEP:]
        places.append(step)
        scores = np.concatenate([scores, cs[step] @ query])
        if len(scores) >= k:
            floor = max(floor, float(np.partition(scores, -k)[-k]))
            if bounds is None:
                bounds = _bounds(q_real, q_norm, floor, real, squares, norms)
                left = left[np.argsort(-bounds[left], kind="stable")]
    return (np.concatenate(places) if places else left), scores, len(scores), floor


def _search(k: int):
    """mapInArrow function over joined block pairs (q..., c..., floors) to scores, and a row with the number of products."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for pair in batch.to_pylist():
                width = max(pair["q_dims"], pair["dims"])
                q_rows, q_ids, qs = _unpack(pair["q_n"], pair["q_dims"], pair["q_rows"], pair["q_ids"], pair["q_vectors"], width)
                rows, ids, cs = _unpack(pair["n"], pair["dims"], pair["rows"], pair["ids"], pair["vectors"], width)
                floors = np.frombuffer(pair["floors"], np.float64) if pair["floors"] else np.full(len(q_rows), -np.inf)
                real = cs.astype(np.float64)
                squares = real * real
                norms = np.sqrt(squares.sum(1))
                out = []
                for i, q in enumerate(qs):
                    found, scores, products, floor = _nearest(q, floors[i], k, rows == q_rows[i], cs, real, squares, norms)
                    enough = scores >= floor
                    found, scores = found[enough], scores[enough]
                    best = np.lexsort((rows[found], ids[found], -scores))[:k]
                    out.append(([q_rows[i]], [q_ids[i]], [-1], [-1], [0], [products]))
                    out.append((np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), ids[found[best]],
                                rows[found[best]], scores[best], np.zeros(len(best), np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)],
                                                     names=["q_row", "query_id", "vec_id", "c_row", "score", "products"])
    return run


FOUND = "q_row long, query_id long, vec_id long, c_row long, score long, products long"


def scored(df: DataFrame, queries: str, k: int, id_col: str, vector_col: str) -> DataFrame:
    """What the block pairs give: candidates with their products, and rows (c_row -1) that count products made."""
    rows = integer_vectors(df, id_col, vector_col)
    band = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 4)).otherwise(-9999)
    blocks = _blocks(rows.withColumn("band", band), BLOCK, ["band"])
    asked = _blocks(rows.filter(queries).withColumn("band", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 32)).otherwise(-9999)), QUERY_BLOCK, ["band"])
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    columns = [*asked.columns, *blocks.columns, "floors"]

    # the longest block, one row of BLOCK vectors, gives the first scores
    longest = blocks.orderBy(F.desc("longest"), "block").limit(1)
    first = asked.join(F.broadcast(longest), F.lit(True)).withColumn("floors", F.lit(None).cast("binary"))
    first = scratch_table(first.select(columns).mapInArrow(_search(k), FOUND), "first-scores")
    kth = first.filter("c_row >= 0").groupBy("q_row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = kth.select("q_row", F.get("s", F.lit(k - 1)).alias("kth"))

    def floors_of(pairs):
        # per query block: its queries' floors in order, and the least length that a candidate needs
        import pyarrow as pa
        for batch in pairs:
            out = []
            for p in batch.to_pylist():
                known = {x["q_row"]: x["kth"] for x in p["found"] or []}
                floors = np.array([known.get(r) if known.get(r) is not None else -np.inf
                                   for r in np.frombuffer(p["q_rows"], np.int64).tolist()], np.float64)
                v = np.frombuffer(p["q_vectors"], np.int64).reshape(p["q_n"], p["q_dims"]).astype(np.float64)
                norms = np.sqrt((v * v).sum(1))
                need = np.where((floors > 0) & (norms > 0), floors / np.where(norms > 0, norms, 1), 0).min()
                out.append((p["q_block"], floors.tobytes(), float(need) * (1 - SLACK)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                                              pa.array([o[2] for o in out], pa.float64())], names=["q_block", "floors", "need"])
    placed = asked.select("q_block", F.col("q_rows"), "q_n", "q_dims", "q_vectors")
    homes = asked.select("q_block", "q_rows").mapInArrow(_homes, "q_block long, q_row long")
    found = homes.join(kth, "q_row").groupBy("q_block").agg(F.collect_list(F.struct("q_row", "kth")).alias("found"))
    floors = placed.join(found, "q_block", "left").select("q_block", "q_rows", "q_n", "q_dims", "q_vectors", "found")
    floors = scratch_table(floors.mapInArrow(floors_of, "q_block long, floors binary, need double"), "floors")

    # pairs of block ids first (a query block meets every block long enough), then the blocks themselves
    meta = blocks.select("block", "longest").join(longest.select(F.col("block").alias("done")),
                                                  F.col("block") == F.col("done"), "left_anti")
    pairs = floors.select("q_block", "floors", "need").join(meta, F.col("longest") >= F.col("need"))
    pairs = pairs.select("q_block", "block", "floors").repartition("q_block", "block")
    rest = pairs.join(asked, "q_block").join(blocks, "block").select(columns).mapInArrow(_search(k), FOUND)
    return first.unionByName(rest)


def top_k(df: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets the condition ``queries`` (SQL on
    vec_id), the k other rows with the highest integer inner products."""
    found = scored(df, queries, k, id_col, vector_col).filter("c_row >= 0")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def products_made(df: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """How many integer products the search makes; without pruning one per query and other row."""
    return scored(df, queries, k, id_col, vector_col).agg(F.sum("products")).first()[0] or 0


def _homes(batches):
    """The block of each query row."""
    import pyarrow as pa
    for batch in batches:
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], names=["q_block", "q_row"])
