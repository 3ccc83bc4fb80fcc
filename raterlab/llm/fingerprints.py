"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits.

The 64-bit hash of each shingle of five words is used once: its high bits name one of BINS bins, and a
bin keeps its smallest hash. An empty bin takes the value of an occupied one, the first that it meets in an
order of its own (a fixed random order per bin, the same for all documents), so two documents
that leave a bin empty choose alike where their occupied bins are alike. Of each value the
lowest BITS bits are kept and packed. Two different values agree in them with probability
2 ** -BITS, which ``likeness`` corrects for.

Documents are compared with an edited text of their own and with their successor by id. One range
shuffle sorts the texts; each task streams its range, holding two texts. Where ranges meet, the last row
of one and the first of the next are paired in a second step, two rows per task.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, whose
likeness is 1 to an empty one and 0 to others; a text of fewer than five words is one shingle; A-Z are
lower-cased; a null doc_id comes before all others; rows with one doc_id (repeated rows too) are documents of
their own, ordered by a hash of their texts; the successor of an only document is itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import map_texts, scratch_table, text_or_empty
from raterlab.llm.ngram_join import shingles

BINS, BITS = 512, 4
#: Occupied bins up to which the choice is made by comparing their ranks, beyond by walking the order.
FEW = 32
#: Characters of texts and results per Arrow batch of results; those of a row besides its text.
HELD, ROW = 1 << 20, 4 * BINS


@lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bin the order in which it meets the others, and their ranks in it."""
    at = np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = (at ^ (at >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort((at ^ (at >> np.uint64(31))).reshape(bins, bins), axis=1, kind="stable")
    ranks = np.argsort(order, axis=1)
    return order.astype(np.int32), ranks.astype(np.int32)


def _densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Values with each empty bin filled from the first occupied bin of its order."""
    bins = len(values)
    order, ranks = _orders(bins)
    empty = np.flatnonzero(~full)
    occupied = np.flatnonzero(full)
    if len(occupied) == 1:
        values[:] = values[occupied[0]]
    elif len(occupied) <= FEW:
        values[empty] = values[occupied[ranks[np.ix_(empty, occupied)].argmin(1)]]
    else:
        turn, source = 0, values.copy()
        while len(empty):
            met = order[empty, turn]
            hit = full[met]
            values[empty[hit]] = source[met[hit]]
            empty, turn = empty[~hit], turn + 1
    return values


def fingerprint(text: str, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed fingerprint; empty without words. ``bins`` is a power of two, ``bits`` divides 8."""
    hashes = shingles(text).view(np.uint64)
    if not len(hashes):
        return b""
    hashes.sort()
    where = (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    values, full = np.zeros(bins, np.uint8), np.zeros(bins, bool)
    values[where[first]] = (hashes[first] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    full[where[first]] = True
    values = _densified(values, full).reshape(-1, 8 // bits)
    packed = np.zeros(len(values), np.uint8)
    for column in values.T:
        packed = (packed << np.uint8(bits)) | column if bits < 8 else column
    return packed.tobytes()


def likeness(one: bytes, two: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less what chance makes equal."""
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    differ = np.frombuffer(one, np.uint8) ^ np.frombuffer(two, np.uint8)
    mask = (1 << bits) - 1
    equal = np.mean([(differ >> np.uint8(s)) & np.uint8(mask) == 0 for s in range(0, 8, bits)])
    chance = 2.0 ** -bits
    return float(max(0.0, (equal - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``keep`` columns with n_chars and fingerprint (hex) of each whole text."""
    def worker():
        return lambda texts: [[len(t) for t in texts], [fingerprint(t, bins, bits).hex() for t in texts]]
    return map_texts(docs, text_col, keep, "n_chars bigint, fingerprint string", worker)


def edited(text: str, after: str) -> str:
    """The last half of a text replaced by as many code points of the text after it."""
    cut = len(text) // 2
    return text[:len(text) - cut] + after[:cut]


def _compared(text: str, print_: bytes, after: str, after_print: bytes, bins: int, bits: int) -> tuple:
    other = edited(text, after)
    other_print = fingerprint(other, bins, bits)
    return (len(text), hashlib.sha256(other.encode("utf-8")).digest(), print_, other_print,
            likeness(print_, other_print, bits), likeness(print_, after_print, bits))


#: As written between the steps; digests and fingerprints become hex in the end.
RESULT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")
EDGES = f"task int, edge int, {RESULT}, text string"


def _batch(rows: list[tuple], ddl: str):
    import pyarrow as pa
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      names=[n for n, _ in fields])


def compare_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS,
                       bits: int = BITS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to the edited text and to the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext
        task, before, ready, held = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                doc, text = ids[i].as_py(), texts[i].as_py()
                print_ = fingerprint(text, bins, bits)
                if before is None:
                    ready.append((task, 1, doc, *[None] * 6, text))
                else:
                    ready.append((task, 0, before[0], *_compared(*before[1:], text, print_, bins, bits), None))
                before, held = (doc, text, print_), held + len(text) + ROW
                if held >= HELD:
                    yield _batch(ready, EDGES)
                    ready, held = [], 0
        if before is not None:
            ready.append((task, 2, before[0], *[None] * 6, before[1]))
        if ready:
            yield _batch(ready, EDGES)
    found = scratch_table(rows.mapInArrow(run, EDGES), "fingerprints")

    # the tasks that had rows, in order: one number per task
    tasks = sorted(r[0] for r in found.filter("edge = 1").select("task").collect())
    following = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, next_task int")
    last = found.filter("edge = 2").select("task", "doc_id", "text").join(F.broadcast(following), "task")
    first = found.filter("edge = 1").select(F.col("task").alias("next_task"), F.col("text").alias("after"))
    pairs = last.join(first, "next_task").select("doc_id", "text", "after")

    def edges(batches):
        for batch in batches:
            for doc, text, after in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([(doc, *_compared(text, fingerprint(text, bins, bits), after, fingerprint(after, bins, bits), bins, bits))], RESULT)
    inner = found.filter("edge = 0").drop("task", "edge", "text")
    out = inner.unionByName(pairs.mapInArrow(edges, RESULT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
