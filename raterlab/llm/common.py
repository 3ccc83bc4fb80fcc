"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlab.session import checkpoint_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A group is "hot" from this share of all rows on, so there are at most HOT_GROUPS hot ones.
HOT_GROUPS = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage is
    cut, a lost executor costs no recomputation, and Spark knows the table's true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


#: The folders of scratch tables that are still in use.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop_tables(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing reads any more: all that came of them is written elsewhere."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            session = table.sparkSession
            folder = session._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def free_driver(spark: SparkSession) -> None:
    """Collects the driver's garbage: plans and results of ended jobs go, and with them Spark's cleaner frees their
    shuffles and broadcasts. A driver that runs hundreds of jobs otherwise keeps these until its heap is full."""
    gc.collect()  # Python's proxies keep what they stand for
    spark._jvm.System.gc()


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` does the same on pure ASCII and is faster."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int,
                  spread: Column) -> DataFrame:
    """``rows`` left join ``groups`` (one row per ``key``) where one key may hold a third of ``rows``.

    Groups of at least ``total / HOT_GROUPS`` rows are at most HOT_GROUPS many, so they are
    broadcast; the others go through an ordinary shuffled join in which no key is hot.
    Rows that found a hot group skip it: their key is replaced by ``spread``, a value
    (of the key's type) that no group has and that differs from row to row.
    """
    facts = [c for c in groups.columns if c != key]
    floor = max(1, -(-total // HOT_GROUPS))
    hot = groups.filter(F.col(size) >= floor).select(key, *[F.col(c).alias(f"hot_{c}") for c in facts])
    cold = groups.filter(F.col(size) < floor).withColumnRenamed(key, "cold_key")
    found = rows.join(F.broadcast(hot), key, "left")
    found = found.withColumn("probe", F.when(F.col(f"hot_{size}").isNull(), F.col(key)).otherwise(spread))
    out = found.join(cold, F.col("probe") == F.col("cold_key"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in facts])


#: Words of 64 bits of a membership filter, at most (4 MB).
MAX_FILTER_WORDS = 1 << 19
FILTER_HASHES = 3


def _filter_cells(keys, words: int):
    """Three cells per key: 16-byte digests (whose bytes are already random) or 64-bit hashes (mixed once more)."""
    import numpy as np
    if isinstance(keys, np.ndarray):
        first = keys.view(np.uint64)
        second = (first ^ (first >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        second ^= second >> np.uint64(29)
    else:
        first, second = np.frombuffer(b"".join(k[:16] for k in keys), "<u8").reshape(-1, 2).T
    cells = words * 64
    return [((first + np.uint64(i) * second) % np.uint64(cells)).astype(np.int64) for i in range(FILTER_HASHES)]


def member_bits(rows: DataFrame, key: str) -> tuple[bytes, int]:
    """A Bloom filter over the 16-byte digests or 64-bit hashes in ``key``, at most MAX_FILTER_WORDS longs: each
    task sets its own bits, equal words are combined in a shuffle, and only the filter reaches the driver, as two
    arrays: a row object for each word would take the driver some 20 times the filter's size."""
    import numpy as np
    want = max(64, rows.count() // 4)
    words = min(MAX_FILTER_WORDS, 1 << (want - 1).bit_length())

    def run(batches):
        import pyarrow as pa
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            keys = batch.column(0)
            keys = keys.to_numpy() if pa.types.is_int64(keys.type) else keys.to_pylist()
            if len(keys):
                for cell in _filter_cells(keys, words):
                    np.bitwise_or.at(bits, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at].view(np.int64))], names=["word", "bits"])
    held = rows.select(key).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(words, np.int64)
    for batch in held.toArrow().to_batches():  # at most MAX_FILTER_WORDS rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.tobytes(), words


def test_bits(bits: bytes, words: int, keys):
    """Whether each key may be in the filter, as a boolean array."""
    import numpy as np
    table = np.frombuffer(bits, np.uint64)
    found = np.ones(len(keys), bool)
    if len(keys):
        for cell in _filter_cells(keys, words):
            found &= (table[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def kept_by_worker(key: str, make):
    """``make()``, once per Python worker process rather than once per task: workers are reused,
    and what a task has learnt (vocabulary tables, words seen) serves the next one."""
    import sys
    import types
    home = sys.modules.setdefault("_raterlab_worker", types.ModuleType("_raterlab_worker"))
    if getattr(home, "key", None) != key:
        home.key, home.value = key, make()
    return home.value


#: Python operators look at this many characters of text at a time.
SLICE_CHARS = 1 << 20


def map_texts(docs: DataFrame, text_col: str, keep: list[str], fields: str, worker) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``fields`` (a DDL list) computed from the whole texts.

    ``worker()`` runs once per task and returns a function from a list of texts (null: empty)
    to one list per field. Rows stream through in slices of about SLICE_CHARS characters, so
    memory is bounded by the longest text. A kept column named like a new field is replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in new.names]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = StructType([source.schema[c] for c in keep] + new.fields)
    types = [f.type for f in to_arrow_schema(new)]
    names = schema.names

    def run(batches):
        compute = worker()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, size = 0, 0
            ends = []
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for i, n in enumerate(lengths):
                if size and size + n > SLICE_CHARS:
                    ends.append(i)
                    size = 0
                size += n
            for end in [*ends, batch.num_rows]:
                part = batch.slice(start, end - start)
                start = end
                values = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [c for c in part.columns[:-1]]
                columns += [pa.array(v, type=t) for v, t in zip(compute(values), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
