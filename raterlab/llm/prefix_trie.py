"""Conversation prefix trie: every distinct prefix of the rebuilt conversations, with totals of its subtree.

Rebuilding: a conversation c starts with the first h turns of conversation c - c % 20, h being
the unsigned crc32 of its decimal id modulo 4, and goes on with its own turns after its first
h. Conversations of a block of 20 are streamed by one task, their leader first, as digests of
their turns; texts are not shuffled. A prefix is known by a chained 128-bit digest.

Totals come by a depth-band rollup. Bands are BAND levels high. A node is exploded to its
ancestors within its own band only, at most BAND rows, and summed there (pre-aggregated, so
a node with a third of all others below it is no hot key). Band roots then hold the total of their
band. They form a trie of their own, BAND times less deep, which is rolled up in the same
way, band of bands by band of bands, until one band is left. Completed totals of band roots go back to
the at most BAND - 1 nodes between them and the band root above. Rounds thus grow with the
logarithm of the depth, and no node is ever exploded to more than BAND others.

Defined results: turns go by turn number (null first), equal numbers by role, then by digest of role and text;
a null role or text counts as empty; repeated rows are turns of their own; rows without a conv_id
belong to no conversation and are left out; % takes the sign of its left side, so ids from -19
to 19 share a block; a conversation without turns of its own left and without a leader ends at the root; an empty
table gives no node; other columns are ignored. The digests of one conversation's prefixes are a chain,
so one task streams it, a turn at a time; so it does with the ids behind one ``ends_sha256``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import HOT_GROUPS, attach_groups, drop_tables, scratch_table

BAND = 4
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
ROOT = b"\0" * 16
#: Members that end at one node from which on their ids are sorted by several tasks; rows per Arrow batch.
HOT_ENDS, ROWS = 100_000, 4096
#: Characters of joined ids in a piece.
PIECE = 1 << 16
PREFIXES = "conv_id long, depth int, node binary, words long, ups array<binary>, ends boolean"


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(block, follows, conv_id, head, turn, role, digest, words) per turn, the block's leader not following."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    conv = F.col(id_col).cast("long")
    rows = rows.filter(F.col(id_col).isNotNull()).select(
        conv.alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    return rows.select(block.alias("block"), (F.col("conv_id") != block).alias("follows"), "conv_id",
                       (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("head"), "turn", "role", "digest", "words")


class _Chain:
    """The prefixes of one conversation, turn by turn; holds the band roots of each height above the last one."""

    def __init__(self, conv: int, band: int) -> None:
        self.conv, self.band = conv, band
        self.paths: list[list[bytes]] = [[ROOT]]
        self.node, self.depth, self.last = ROOT, 0, (conv, 0, ROOT, 0, [], True)

    def add(self, digest: bytes, words: int) -> tuple:
        """The row of the prefix before, which does not end here."""
        done = (*self.last[:5], False)
        self.node = hashlib.sha256(self.node + digest).digest()[:16]
        self.depth += 1
        ups, step, level = list(self.paths[0]), self.depth, 0
        while step % self.band == 0:
            self.paths[level] = [self.node]
            step, level = step // self.band, level + 1
            if level == len(self.paths):
                self.paths.append([ROOT])
            ups += self.paths[level]
        self.paths[level].append(self.node)
        self.last = (self.conv, self.depth, self.node, words, ups, True)
        return done


def prefixes(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", band: int = BAND) -> DataFrame:
    """One row per rebuilt conversation and prefix, the empty one included. ``ups`` lists ancestors: those from the band
    root above to the parent, then, for band roots, the band roots of their band of bands, and so on."""
    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    turns = turns.repartition("block").sortWithinPartitions("block", "follows", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    turns = turns.select("block", "follows", "conv_id", "head", "digest", "words")

    def run(batches):
        import pyarrow as pa
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.bool_()]
        names = ["conv_id", "depth", "node", "words", "ups", "ends"]
        ready: list[tuple] = []
        block, chain, leader, own = (), None, [], 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready), types)], names=names)
            ready.clear()
            return made
        for batch in batches:
            for b, follows, conv, head, digest, words in zip(*(c.to_pylist() for c in batch.columns)):
                if block != (b,):
                    block, leader = (b,), []
                if chain is None or chain.conv != conv:
                    if chain is not None:
                        ready.append(chain.last)
                    chain, own = _Chain(conv, band), 0
                    if follows:
                        ready += [chain.add(*turn) for turn in leader[:head]]
                if not follows:
                    if len(leader) < HEADS - 1:
                        leader.append((digest, words))
                    ready.append(chain.add(digest, words))
                elif own >= head:
                    ready.append(chain.add(digest, words))
                own += 1
                if len(ready) >= ROWS:
                    yield out()
        if chain is not None:
            ready.append(chain.last)
        if ready:
            yield out()
    return turns.mapInArrow(run, PREFIXES)


AMOUNTS = ["n_leaves", "saved_tokens"]


def _sums() -> list[Column]:
    return [F.sum(a).cast("long").alias(a) for a in AMOUNTS]


def rollup(nodes: DataFrame, deepest: int, band: int = BAND, level: int = 0) -> DataFrame:
    """(node, amounts) summed over each node's subtree, for ``nodes`` (node, depth, ups, amounts): all prefixes at level 0,
    those whose depth divides by band ** level above."""
    step = band ** level
    height = (F.col("depth") / step).cast("long") % band  # 0: a band root
    within = F.when(height == 0, F.array().cast("array<binary>")).otherwise(F.slice("ups", F.lit(level * band + 1), height.cast("int")))
    first = F.when(height == 0, F.lit(0)).otherwise(F.lit(1))  # where its band root stands
    spread = nodes.select(F.posexplode(F.concat(F.array("node"), within)).alias("pos", "up"), first.alias("first"), *AMOUNTS)
    totals = spread.groupBy(F.col("up").alias("node"), (F.col("pos") == F.col("first")).alias("top")).agg(*_sums())
    if step * band > deepest:
        return totals.drop("top")
    totals = scratch_table(totals, f"trie-totals-{level}")
    tops = nodes.filter(height == 0).select("node", "depth", "ups")
    done = rollup(tops.join(totals.filter("top").drop("top"), "node"), deepest, band, level + 1)
    done = scratch_table(done, f"trie-tops-{level}")
    # each completed band root to the nodes between it and the band root above
    down = tops.filter("depth > 0").join(done, "node").select(
        F.explode(F.slice("ups", level * band + 2, band - 1)).alias("node"), *AMOUNTS)
    inner = totals.filter("not top").drop("top").unionByName(down).groupBy("node").agg(*_sums())
    return inner.unionByName(done)


def _ends(found: DataFrame, nodes: DataFrame, hot_ends: int) -> DataFrame:
    """(node, ends_sha256) of the nodes at which members end. The ids of nodes with very many are sorted by range over
    several tasks and joined to pieces first; then each node's pieces stream through in order."""
    ends = found.filter("ends").select("node", "conv_id")
    # as many nodes as HOT_GROUPS at most
    hot = nodes.filter(F.col("n_ends") >= hot_ends).select("node")
    few = ends.join(F.broadcast(hot), "node", "left_anti").select("node", "conv_id", F.col("conv_id").cast("string").alias("piece"))
    many = ends.join(F.broadcast(hot), "node", "left_semi").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(batches):
        import pyarrow as pa
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.binary()), pa.array([held[0][1]], pa.int64()),
                                               pa.array([",".join(str(c) for _, c in held)], pa.string())], names=["node", "conv_id", "piece"])
        for batch in batches:
            for node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != node or size >= PIECE):
                    yield out()
                    held, size = [], 0
                held.append((node, conv))
                size += len(str(conv)) + 1
        if held:
            yield out()

    def digests(batches):
        import pyarrow as pa
        node, digest, ready = None, None, []
        for batch in batches:
            for n, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if n != node:
                    if node is not None:
                        ready.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*ready)], names=["node", "ends_sha256"])
                ready = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
    every = few.unionByName(many.mapInArrow(pieces, "node binary, conv_id long, piece string"))
    every = every.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "piece")
    return every.mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", band: int = BAND, hot_ends: int = HOT_ENDS) -> DataFrame:
    """One row per node: node (its digest), conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    found = scratch_table(prefixes(rows, id_col, turn_col, role_col, text_col, band), "trie-prefixes")
    nodes = found.groupBy("node", "depth", "words", "ups").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    parent = F.when(F.col("depth") > 0, F.get("ups", ((F.col("depth") - 1) % band).cast("int"))).alias("parent")
    nodes = scratch_table(nodes.select("*", parent), "trie-nodes")
    deepest, total, members = nodes.agg(F.max("depth"), F.count("*"), F.max("n_convs")).first()

    own = nodes.select("node", "depth", "ups", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rollup(own, deepest or 0, band)
    children = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    ends = _ends(found, nodes, max(hot_ends, -(-(members or 0) // HOT_GROUPS)))
    whole = (nodes.select("node", "parent", "conv_id", "depth", "n_convs").join(totals, "node")
             .join(children, "node", "left").join(ends, "node", "left"))
    whole = whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    whole = scratch_table(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie-whole")
    drop_tables(found, nodes)

    parents = whole.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                    F.col("n_children").alias("size"))
    out = attach_groups(whole, parents, "parent", "size", total, F.encode(F.concat(F.lit("none"), "node"), "UTF-8"))
    return out.select("node", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                      "n_leaves", "saved_tokens", "ends_sha256")
