"""One JSON document ``{key: [element, ...], ...}`` read by many tasks, and written.

Spark's text reader cuts a file of any size into blocks and, with a line separator that closes or parts elements,
into pieces. Whether a separator is structure or lies inside a string depends on everything before it, but only through two small numbers:
whether a string is open and how deep the nesting is. Each piece states how it changes both; sums within a block
and then over the blocks of a file (one row each) give every piece its state, so no task sees more than a block.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# a JSON string, without backtracking; a key with the bracket of its list; what stands before an element
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_KEY = rf'(?s)({_STRING})\s*:\s*\['
_HEAD = rf'(?s)^[\s\],]*((?:{_STRING}\s*:\s*\[[\s\],]*+)*)(.*)$'

IN_BLOCK = ["file", "block"]


def _carried(blocks: DataFrame, name: str) -> Column:
    """The sum of ``name`` over the earlier blocks of a file."""
    return F.coalesce(F.sum(name).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Pieces between separators: whether they hold an odd number of quotes, and how they change the depth if they start
    outside a string (``d0``) or inside one (``d1``). Each task has its blocks whole and in the order of the file."""
    p = spark.read.text(path, lineSep=sep).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value")
    # an escape never spans a separator, for neither may be escaped
    plain = F.when(F.instr("value", "\\") > 0, F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    p = p.withColumn("parts", F.split(plain, '"', -1))
    p = p.withColumn("odd", ((F.size("parts") - 1) % 2).cast("long"))

    def change(inside: int) -> Column:
        text = F.array_join(F.filter("parts", lambda x, k: k % 2 == inside), "")
        less_opening, less_closing = (F.replace(F.replace(text, F.lit(x)), F.lit(y)) for x, y in ("{[", "}]"))
        return (F.octet_length(less_closing) - F.octet_length(less_opening) - (F.when(F.col("odd") == inside, 1).otherwise(0) if sep == "}" else F.lit(0))).cast("long")
    return p.withColumn("d0", change(0)).withColumn("d1", change(1)).drop("parts")


def _in_block(batches):
    """Rows that lie in one block each (columns file and block come first), and whether they begin it."""
    last = None
    for batch in batches:
        block = batch.column(1).to_numpy()
        file = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if start < end:
                here = batch.column(0)[start].as_py(), int(block[start])
                yield batch.slice(start, end - start), here != last
                last = here


def _before(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values) - values


def _block_sums(batches):
    """How the pieces of a block change what is open if the block starts outside a string (``out``) or inside one (``inside``)."""
    import pyarrow as pa
    turned = 0
    for rows, begins in _in_block(batches):
        odd, d0, d1, size = (rows.column(c).to_numpy() for c in ("odd", "d0", "d1", "bytes"))
        turned = 0 if begins else turned
        now = (turned + _before(odd)) % 2
        sums = [odd, np.where(now == 0, d0, d1), np.where(now == 0, d1, d0), size]
        turned = (turned + odd.sum()) % 2
        yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(0, 1) for c in IN_BLOCK), *(pa.array([int(x.sum())]) for x in sums)],
                                         names=[*IN_BLOCK, "odd", "out", "inside", "bytes"])


def _segments(sep: str):
    """Elements, or what a block and a batch have of them: the place of their first piece, whether they are whole and whether they end."""
    def run(batches):
        import pyarrow as pa
        for rows, begins in _in_block(batches):
            odd, d0, d1, value = (rows.column(c) for c in ("odd", "d0", "d1", "value"))
            odd, d0, d1 = odd.to_numpy(), d0.to_numpy(), d1.to_numpy()
            if begins:
                # only the file's first block is known to begin with an element
                state, deep, place, ended = rows.column("open")[0].as_py(), rows.column("deep")[0].as_py(), 0, rows.column(1)[0].as_py() == 0
            inside = (state + _before(odd)) % 2
            change = np.where(inside == 0, d0, d1)
            start = deep + _before(change)
            for k in np.flatnonzero(start <= 0).tolist():
                if (k + place or rows.column(1)[0].as_py()) and value[k].as_py().strip(" \n\r\t"):
                    raise ValueError(f"text after the JSON document: {rows.column(0)[0].as_py()}")
            ends = ((inside + odd) % 2 == 0) & (start + change <= 2)
            after = np.flatnonzero(ends) + 1
            cuts = np.concatenate([[0], after, [] if len(after) and after[-1] == len(ends) else [len(ends)]]).astype(np.int32)
            done = ends[cuts[1:] - 1]
            whole = done.copy()
            whole[0] &= ended
            text = value if len(cuts) > len(ends) else pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(cuts), value), sep)
            at = pa.array(np.zeros(len(done), np.int64))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in IN_BLOCK), pa.array(place + cuts[:-1].astype(np.int64)),
                                              pa.array(whole), pa.array(done.astype(np.int64)), text],
                                             names=[*IN_BLOCK, "i", "whole", "done", "text"])
            state, deep, place, ended = (state + odd.sum()) % 2, deep + change.sum(), place + len(odd), bool(ends[-1])
    return run


def elements(spark: SparkSession, path: str, objects: bool) -> DataFrame:
    """(key, element): the elements' JSON texts of every document under ``path`` (uncompressed files, one document each).
    ``objects``: elements are objects, else they are scalars. A key that stands twice has the elements of both places; keys with an
    empty list, empty documents and empty files have no row. A document that is cut off or has another shape raises."""
    sep = "}" if objects else ","
    p = _pieces(spark, path, sep)
    b = p.select(*IN_BLOCK, "odd", "d0", "d1", (F.octet_length("value") + 1).cast("long").alias("bytes")).mapInArrow(
        _block_sums, "file string, block long, odd long, out long, inside long, bytes long")
    b = b.groupBy(*IN_BLOCK).agg(*[F.sum(c).alias(c) for c in ("odd", "out", "inside", "bytes")])
    b = b.withColumn("open", _carried(b, "odd") % 2)
    b = b.withColumn("change", F.when(F.col("open") == 0, F.col("out")).otherwise(F.col("inside")))
    all_of = Window.partitionBy("file")
    b = b.withColumn("read", F.sum("bytes").over(all_of)).withColumn("closed", F.sum("odd").over(all_of) % 2 == 0)
    b = b.select(*IN_BLOCK, "open", _carried(b, "change").alias("deep"), "read", "closed", F.sum("change").over(all_of).alias("left"))
    # a row a block; by broadcast, so that the pieces stay where and as they are
    p = p.join(F.broadcast(b), IN_BLOCK)
    # a last piece that no separator ends is counted as if one did
    unended = F.when(F.col("read") != F.col("size"), F.lit(-1 if objects else 0)).otherwise(0)
    p = p.withColumn("value", F.when(F.col("closed") & (F.col("left") == unended), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("no whole JSON document: "), F.col("file")))))
    s = p.select(*IN_BLOCK, "odd", "d0", "d1", "open", "deep", "value").mapInArrow(
        _segments(sep), "file string not null, block long not null, i long not null, whole boolean not null, done long not null, text string not null")
    # few elements lie in two blocks or batches; each ends where one of their parts does
    parts = s.filter("not whole").withColumn("earlier", F.coalesce(F.sum("done").over(
        Window.partitionBy("file").orderBy("block", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.groupBy("file", "earlier").agg(F.array_sort(F.collect_list(F.struct("block", "i", "text"))).alias("v"))
    e = s.filter("whole").select(*IN_BLOCK, "i", "text").unionByName(parts.select(
        "file", F.col("v")[0]["block"].alias("block"), F.col("v")[0]["i"].alias("i"), F.array_join(F.col("v.text"), sep).alias("text")))
    text = F.concat(F.col("text"), F.lit(sep if objects else ""))
    first = F.when(text.rlike(r"^\s*\{"), F.regexp_replace(text, r"^\s*\{", "")).otherwise(
        F.raise_error(F.concat(F.lit("no JSON object: "), F.col("file"))))
    e = e.withColumn("text", F.when((F.col("block") == 0) & (F.col("i") == 0), first).otherwise(text))
    e = e.select(*IN_BLOCK, "i", F.regexp_extract("text", _HEAD, 1).alias("head"), F.regexp_extract("text", _HEAD, 2).alias("body"))
    e = e.withColumn("key", F.try_element_at(F.regexp_extract_all("head", F.lit(_KEY), F.lit(1)), F.lit(-1)))
    e = e.withColumn("body", F.when(F.trim(F.col("body")) == "}", "").otherwise(F.col("body")) if objects
                     else F.regexp_replace("body", r"[\s\]}]+$", ""))
    # an element without a key of its own belongs to the last one before it; the keys are found where the elements lie
    k = e.groupBy(*IN_BLOCK).agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("i"))).alias("last"))
    k = k.select(*IN_BLOCK, F.last("last", True).over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # the one shuffle of elements
    own = F.last("key", True).over(Window.partitionBy(*IN_BLOCK).orderBy("i"))
    e = e.withColumn("own", own).join(F.broadcast(k), IN_BLOCK).filter(F.col("body") != "")
    key = F.coalesce("own", "carried", F.raise_error(F.concat(F.lit("an element without a key: "), F.col("file"))))
    return e.select(F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>", {"mode": "FAILFAST"})[0].alias("key"),
                    F.col("body").alias("element"))


def write(df: DataFrame, key: str, element: Column, path: str, order: str = "id", rows_per_document: int = 100_000) -> None:
    """Documents ``{key: [element, ...]}`` of about ``rows_per_document`` elements under ``path``, rows dealt to them by the hash of
    ``order``, each in its order of key and ``order``. ``element`` is JSON text. Rows with a null key are not expected and raise."""
    documents = 1 + df.count() // rows_per_document
    name = F.to_json(F.struct(F.coalesce(key, F.raise_error(F.lit("a row without a key"))).alias("k")))
    x = df.select(F.pmod(F.xxhash64(order), F.lit(documents)).alias("document"), F.col(order).alias("o"),
                  F.substring(name, 6, 2**31 - 1).alias("k"), element.alias("e"))
    x = x.withColumn("k", F.expr("left(k, length(k) - 1)"))   # the key as a JSON string
    w = Window.partitionBy("document").orderBy("k", "o")
    before, after = F.lag("k").over(w), F.lead("k").over(w)
    lead = F.when(before.isNull(), F.concat(F.lit("{"), F.col("k"), F.lit(": ["))).when(
        before != F.col("k"), F.concat(F.lit("], "), F.col("k"), F.lit(": ["))).otherwise(F.lit(", "))
    value = F.concat(lead, F.col("e"), F.when(after.isNull(), F.lit("]}")).otherwise(F.lit("")))
    # a document's rows lie in one task, in order: one file a folder
    x.select("document", value.alias("value")).write.mode("overwrite").partitionBy("document").text(path)
