"""WARC archives: a deterministic sharded writer and its reader.

Pages are cut into shards, contiguous ranges in the order of (page_id, payload digest), found from exact
histograms of bytes: a range that holds more than a shard's bytes is split sixteenfold, level by level, until none does or
one page_id and payload is left; neighbours within one split are put together again. Shards depend
on the data alone. Each shard is sorted and streamed by one task into gzip members, one per record; a file is
closed when its compressed size reaches ``roll_bytes``. Headers, record ids and digests are regenerated
from the data and nothing else, so a task that runs again writes the same bytes. Every attempt of a task writes files
of its own temporary names; the attempts that Spark committed are listed, and only then their files are
renamed, which can be repeated, and the manifest written. What other attempts left is removed.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest
page_id is a response, the others are revisits of it without payload; smaller ones are all
responses. Defined results: a null html is an empty payload; a null page_id sorts first, is
never the smallest of others and reads back as null; where all pages of a payload are without page_id, the first
of them is the response and the others are revisits whose refers_to is null; of repeated rows with the smallest
page_id the first is the response; line breaks in a url are percent-encoded and a null url
has no header; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterlab.llm.common import attach_groups, drop_tables, scratch_table, text_or_empty

#: Bytes of payload from which equal payloads are stored once; compressed bytes of a file;
#: bytes of payload in a shard, raised where there would be more than MAX_SHARDS.
MIN_REVISIT = 100
ROLL_BYTES = 64 << 20
SHARD_BYTES = 8 << 20
MAX_SHARDS = 20_000
#: Length of a sort key in hex digits: null flag, page_id, half the digest. Bytes that a record takes besides its payload.
KEY, RECORD = 1 + 16 + 32, 512
DATE = "2024-01-01T00:00:00Z"
#: fixed value: the profile of revisits by equal payload
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
MANIFEST = "shard string, part int, file string, records long, bytes long, sha256 string"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def _sha256(data: bytes) -> str:
    """The labelled digest of WARC headers."""
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _header_text(value: str) -> str:
    return "".join(f"%{b:02X}" if b < 32 or b == 127 else chr(b) for b in value.encode("utf-8")).encode("latin-1").decode("utf-8")


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member (time stamp 0)."""
    head = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers if v is not None]
    head.append(f"Content-Length: {len(block)}".encode())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(CRLF.join(head) + CRLF * 2 + block + CRLF * 2) + z.flush()


def _http(payload_bytes: int) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n").encode()


class _Shard:
    """The files of one shard."""

    def __init__(self, fs, base: str, shard: str, roll_bytes: int) -> None:
        self.fs, self.base, self.shard, self.roll = fs, base, shard, roll_bytes
        self.part, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard}-{self.part:05d}.warc.gz"
            self.temporary = f".{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
            info = f"software: sharded archive\r\nformat: WARC/1.1\r\nfilename: {self.name}\r\n".encode()
            self._write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", self.name)),
                                 ("WARC-Date", DATE), ("WARC-Filename", self.name),
                                 ("Content-Type", "application/warc-fields")], info))
        self._write(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, self.name, self.records, self.size, self.digest.hexdigest(), self.temporary))
            self.out, self.part = None, self.part + 1


def _decisions(pages: DataFrame, id_col: str, html_col: str, min_revisit: int) -> tuple[DataFrame, DataFrame]:
    """(page_id, bytes) facts, and for each page that is a revisit (page_id, digest, refers_to)."""
    html = text_or_empty(html_col)
    facts = scratch_table(pages.select(F.col(id_col).alias("page_id"), F.unhex(F.sha2(html, 256)).alias("digest"),
                                       F.octet_length(html).cast("long").alias("bytes"),
                                       F.monotonically_increasing_id().alias("row_no")), "payloads")
    large = facts.filter(F.col("bytes") >= min_revisit)
    # a group without any id decides in the writer, where its rows are neighbours
    groups = (large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("size"))
              .filter("size > 1 and refers_to is not null"))
    groups = scratch_table(groups, "payload-groups")
    spread = F.encode(F.col("row_no").cast("string"), "UTF-8")
    found = attach_groups(large, groups, "digest", "size", facts.count(), spread)
    revisits = found.filter("size is not null").filter("page_id is null or page_id <> refers_to")
    revisits = scratch_table(revisits.select("page_id", "digest", "refers_to").distinct(), "revisits")
    drop_tables(groups)
    return facts, revisits


def _sort_key(page_id: str, digest: str) -> Column:
    """(page_id, digest) as hex digits that sort alike, null ids first."""
    number = F.lpad(F.hex(F.col(page_id).cast("long").bitwiseXOR(F.expr("shiftleft(1L, 63)"))), 16, "0")
    number = F.when(F.col(page_id).isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), number))
    return F.concat(number, F.substring(F.hex(digest), 1, KEY - 17))


def _shards(facts: DataFrame, shard_bytes: int) -> list[tuple[int, DataFrame]]:
    """Per level the length of its keys' prefixes and a table (cell, shard) of those that are whole within a shard.
    A level has at most 16 cells per range that is still too large, so at most 16 * MAX_SHARDS."""
    keyed = scratch_table(facts.select(_sort_key("page_id", "digest").alias("key"), (F.col("bytes") + RECORD).alias("bytes")), "keys")
    low, high, total = keyed.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    shard_bytes = max(shard_bytes, -(-(total or 0) // MAX_SHARDS))
    common = os.path.commonprefix([low or "", high or ""])[:KEY - 1]
    parents = facts.sparkSession.createDataFrame([(common,)], "parent string")
    levels, done = [], [keyed]
    for length in range(len(common) + 1, KEY + 1):
        cells = keyed.join(F.broadcast(parents), F.substring("key", 1, length - 1) == F.col("parent"))
        cells = scratch_table(cells.groupBy("parent", F.substring("key", 1, length).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        done.append(cells)
        whole = cells if length == KEY else cells.filter(F.col("bytes") <= shard_bytes)
        # sixteen cells of one parent at most: those between two cuts are one shard, named after its first
        before = F.sum("bytes").over(Window.partitionBy("parent").orderBy("cell")) - F.col("bytes")
        cut = cells.select("parent", "cell", F.floor(before / shard_bytes).alias("cut"))
        named = whole.join(cut, ["parent", "cell"]).select("cell", F.min("cell").over(Window.partitionBy("parent", "cut")).alias("shard"))
        levels.append((length, scratch_table(named, "shards")))
        parents = cells.filter(F.col("bytes") > shard_bytes).select(F.col("cell").alias("parent"))
        if length == KEY or not parents.take(1):
            break
    drop_tables(*done)
    return levels


def write_archive(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archive to ``out_dir`` (any file system that pyarrow opens; all executors must
    share it) and returns its manifest, which lies there as Parquet."""
    spark = pages.sparkSession
    facts, revisits = _decisions(pages, id_col, html_col, min_revisit)
    levels = _shards(facts, shard_bytes)
    drop_tables(facts)
    count = sum(cells.select("shard").distinct().count() for _, cells in levels)

    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                        F.unhex(F.sha2(html, 256)).alias("digest"))
    rv = revisits.select(F.col("page_id").alias("rv_id"), F.col("digest").alias("rv_digest"), "refers_to")
    rows = rows.join(rv, (F.col("digest") == F.col("rv_digest")) & F.col("page_id").eqNullSafe(F.col("rv_id")), "left")
    revisit = F.col("rv_digest").isNotNull()
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "bytes",
                       "refers_to", revisit.alias("revisit"), _sort_key("page_id", "digest").alias("key"))
    for length, cells in levels:
        cells = cells.select(F.col("cell").alias(f"cell{length}"), F.col("shard").alias(f"shard{length}"))
        rows = rows.join(F.broadcast(cells), F.substring("key", 1, length) == F.col(f"cell{length}"), "left")
    rows = rows.withColumn("shard", F.coalesce(*[f"shard{length}" for length, _ in levels]))
    rows = rows.repartition(max(1, count), "shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    rows = rows.select("shard", "page_id", "url", "html", "digest", "bytes", "refers_to", "revisit")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(base, recursive=True)
        open_shard, before = None, None
        for batch in batches:
            done = []
            cols = batch.columns
            for i in range(batch.num_rows):
                shard, page, url, text, digest, size, refers, again = (c[i].as_py() for c in cols)
                if open_shard is None or open_shard.shard != shard:
                    if open_shard is not None:
                        open_shard.close()
                        done += open_shard.done
                    open_shard = _Shard(fs, base, shard, roll_bytes)
                twin = before == (page, digest)
                number = number + 1 if twin else 0  # noqa: F821 — set by the first row
                before = (page, digest)
                if twin and size >= min_revisit and not again:
                    again, refers = True, page
                payload = None if again else text.encode("utf-8")
                headers = [("WARC-Type", "revisit" if again else "response"),
                           ("WARC-Record-ID", _record_id(page, digest, number)), ("WARC-Date", DATE),
                           ("WARC-Target-URI", None if url is None else _header_text(url)),
                           ("WARC-Page-ID", page),
                           ("WARC-Payload-Digest", "sha256:" + base64.b32encode(digest).decode().rstrip("="))]
                if again:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, digest, 0)),
                                ("WARC-Refers-To-Page-ID", refers)]
                block = _http(size) + (payload or b"")
                headers += [("WARC-Block-Digest", _sha256(block)), ("Content-Type", "application/http;msgtype=response")]
                open_shard.add(_member(headers, block))
            if open_shard is not None:
                done += open_shard.done
                open_shard.done = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=NAMES).cast(_manifest_schema())
        if open_shard is not None:
            open_shard.close()
            if open_shard.done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*open_shard.done)],
                                                 names=NAMES).cast(_manifest_schema())

    attempts = scratch_table(rows.mapInArrow(run, ATTEMPTS), "attempts")
    _commit(attempts, out_dir)
    attempts.drop("temporary").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    drop_tables(revisits, attempts, *[cells for _, cells in levels])
    return spark.read.parquet(f"{out_dir}/manifest")


def _commit(attempts: DataFrame, out_dir: str) -> None:
    """Gives the files of committed attempts their names. A task that runs again finds the file under its name, or another
    attempt of the same bytes there, and goes on."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for file, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here, there = fs.get_file_info([f"{base}/{temporary}", f"{base}/{file}"])
                if here.type != pafs.FileType.NotFound:
                    if there.type != pafs.FileType.NotFound:
                        fs.delete_file(there.path)
                    fs.move(here.path, there.path)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])
    files = attempts.select("file", "temporary").repartition("file")
    if files.mapInArrow(run, "file string").distinct().count() != attempts.count():
        raise ValueError("two shards have files of one name")
    # whatever else is temporary belongs to attempts that were not committed
    from pyarrow import fs as pafs
    fs, base = pafs.FileSystem.from_uri(out_dir)
    for left in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if left.base_name.startswith(".pages-") and left.base_name.endswith(".tmp"):
            fs.delete_file(left.path)


ATTEMPTS = f"{MANIFEST}, temporary string"
NAMES = ["shard", "part", "file", "records", "bytes", "sha256", "temporary"]


def _manifest_schema():
    import pyarrow as pa
    return pa.schema([("shard", pa.string()), ("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()),
                      ("bytes", pa.int64()), ("sha256", pa.string()), ("temporary", pa.string())])


def _records(stream, chunk: int = 1 << 20):
    """The records of a gzip-member stream: (headers, block), one member in memory at a time."""
    raw = stream.read(chunk)
    while raw:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not raw:
                raise ValueError("the file ends inside a record")
            parts.append(z.decompress(raw))
            raw = z.unused_data if z.eof else stream.read(chunk)
        if not raw:
            raw = stream.read(chunk)
        data = b"".join(parts)
        head, _, rest = data.partition(CRLF * 2)
        lines = head.decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != CRLF * 2:
            raise ValueError("a record's length is wrong")
        yield headers, rest[:size]


def _unlabelled(digest: str) -> str:
    value = digest.removeprefix("sha256:")
    return base64.b32decode(value + "=" * (-len(value) % 8)).hex()


def read_archive(spark: SparkSession, out_dir: str, payloads: bool = False) -> DataFrame:
    """The records of the files in the manifest, each checked against its digests and its file
    against the manifest. ``payload`` is null unless ``payloads``."""
    files = spark.read.parquet(f"{out_dir}/manifest").select("file", "records")
    files = files.repartition(max(1, files.count()), "file")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(out_dir)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for headers, block in _records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if _sha256(block) != headers["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: a block does not match its digest")
                        http, _, payload = block.partition(CRLF * 2)
                        digest = _unlabelled(headers["WARC-Payload-Digest"])
                        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{file}: a payload does not match its digest")
                        page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), headers.get("WARC-Target-URI"), kind, size, digest,
                                     None if refers is None else int(refers),
                                     payload if payloads and kind == "response" else None))
                        seen, held = seen + 1, held + (len(payload) if payloads else 0)
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{file}: {seen} records, the manifest has {expected}")
                if rows:
                    yield batch_of(rows)
    return files.mapInArrow(run, RECORDS)
