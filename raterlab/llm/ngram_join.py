"""Near duplicates by Jaccard similarity of word shingles: a prefix join with adaptive multi-match prefixes.

Shingles are 64-bit hashes, ordered by value. Of a set of n, any partner at similarity 0.8
or more shares a shingle within the first p = n - ceil(0.8 n) + 1. Where some of these are
common (their candidate cost, the number of sets that hold them, is above HOT), the prefix
is lengthened by as many shingles: l - 1 more shingles, of which l must be shared, so that
at least one shared shingle is a rare one, and only rare ones are looked up. Sets that run
out of rare shingles fall back to common ones.

Equal sets become one class first. As only components are asked for, candidates come in
two steps: every looked-up shingle links its sets to a few pivots (linear in the lists,
however large a group of copies is; a shared shingle must have the place in both sets that the
demanded number implies), and then the pairs that still lie in different components. Of these a pair
is verified if it shares as many looked-up shingles as its sizes demand (``needed``), counted over all of them.
Before they are counted, 512 parity bits of each set bound how much two sets differ (``_may_match``): near copies
of one text that are not similar to each other share most looked-up shingles and differ too much all the same.
Both conditions hold for every similar pair, so that no link that matters is lost, and no group is expanded into
all its pairs.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a
text of fewer than five words is one shingle, its whole word sequence; component_id is the
smallest doc_id that links reach; a document without a doc_id belongs to its class but names
none; repeated rows are copies; an empty table gives an empty result; whole texts count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlab.llm.common import drop_tables, free_driver, map_texts, member_bits, scratch_table, test_bits
from raterlab.llm.components import components

WORDS = 5
#: A shingle that more sets hold is common: its list is not looked up where rarer ones serve.
HOT = 64
#: Pivots per list, and rounds of linking to pivots at most.
PIVOTS, ROUNDS = 2, 8
_KEY = "0123456789abcdef"


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (A-Z lower-cased, words between ASCII white space)."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), hash_key=_KEY, categorize=False)
    width = min(WORDS, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:len(h) - width + 1 + k]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((out ^ (out >> np.uint64(30))).view(np.int64))


#: Longs of a set's parity bits.
PARITY_LONGS = 8


def parity(tokens: np.ndarray) -> np.ndarray:
    """Per cell of the hashes, whether an odd number of a set's shingles falls into it. Every shingle that two
    sets do not share changes one cell of one of them, so they differ in at most as many bits as shingles."""
    cells = np.bincount(tokens & (64 * PARITY_LONGS - 1), minlength=64 * PARITY_LONGS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def text_digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8"))


def prefix_length(n):
    """Shingles that must be looked up in a set of n."""
    return n - (4 * n + 4) // 5 + 1


def _prefix(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def needed(n1: Column, n2: Column) -> Column:
    """Looked-up shingles that sets of these sizes share if they are similar: the overlap
    ceil(4 (n1 + n2) / 9) less what can lie beyond the prefixes."""
    beyond = F.greatest(n1 - _prefix(n1), n2 - _prefix(n2))
    return F.greatest(F.lit(1), F.ceil(4 * (n1 + n2) / 9) - beyond)


def _similar_sizes(n1: Column, n2: Column) -> Column:
    return (5 * n1 >= 4 * n2) & (5 * n2 >= 4 * n1)


def _may_match(n1: Column, bits1: Column, n2: Column, bits2: Column) -> Column:
    """Whether sets of these sizes and parity bits may be similar: they share at least ceil(4 (n1 + n2) / 9)
    shingles then, and each shingle that is not shared changes at most one bit."""
    differ = sum((F.bit_count(bits1[k].bitwiseXOR(bits2[k])) for k in range(PARITY_LONGS)), F.lit(0))
    return _similar_sizes(n1, n2) & (differ <= n1 + n2 - 2 * F.ceil(4 * (n1 + n2) / 9))


def _matches(n1: Column, place1: Column, n2: Column, place2: Column) -> Column:
    """Whether a shared shingle may make a pair. Similar sets share at least ``needed`` looked-up
    shingles; the rarest of these has as many more frequent ones before it in either set but one."""
    least = needed(n1, n2)
    return _similar_sizes(n1, n2) & (place1 >= least) & (place2 >= least)


def _whole_sets(docs: DataFrame, text_col: str, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, tokens) of the wanted nodes, from the texts. A bounded Bloom filter over the digests
    of one text of each wanted class spares most other texts the shingling; the join is exact."""
    sigs = scratch_table(wanted.join(classes.select("node", "n", "sig", "raw"), "node"), "wanted")
    bits, words = member_bits(sigs, "raw")

    def worker():
        seen = set()  # a text that comes again in the task is not given twice

        def compute(texts):
            raw = [text_digest(t) for t in texts]
            sets = []
            for t, r, may in zip(texts, raw, test_bits(bits, words, raw)):
                sets.append(shingles(t) if may and r not in seen else None)
                if may:
                    seen.add(r)
            return [[None if s is None else signature(s) for s in sets], sets]
        return compute
    found = map_texts(docs, text_col, [], "sig binary, tokens array<bigint>", worker).filter("sig is not null")
    found = found.join(sigs.drop("raw"), "sig").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    found = scratch_table(found, "sets")
    drop_tables(sigs)
    return found


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    # by shuffle: compressed files hide how large sets are
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ta, tb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = ta[i].values.to_numpy(), tb[i].values.to_numpy()
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both_n >= 4 * (len(x) + len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
    return scratch_table(both.mapInArrow(run, "a long, b long"), "links")


def stored_length(n):
    """Shingles kept of a set of n: its prefix and a quarter more, to lengthen it without the text."""
    p = prefix_length(n)
    return min(n, p + p // 4 + 16)


def _rows_of(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, node, n, pos) of the stored shingles among ``tokens``, and what these have besides. A bounded
    Bloom filter over them spares the shuffle most other shingles; the join is exact."""
    bits, words = member_bits(tokens, "token")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(2)
            found = lists.flatten().to_numpy()
            ends = np.diff(lists.offsets.to_numpy())
            starts = np.repeat(np.cumsum(ends) - ends, ends)
            keep = np.flatnonzero(test_bits(bits, words, found))
            row = np.repeat(np.arange(batch.num_rows), ends)[keep]
            columns = [found[keep], batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], (np.arange(len(found)) - starts)[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "node", "n", "pos"])
    rows = classes.select("node", "n", "prefix").mapInArrow(run, "token long, node long, n long, pos long")
    return rows.join(tokens, "token")


def _looked_up(rows: DataFrame, hots: DataFrame) -> DataFrame:
    """The rows within the prefix of their set, common shingles (whose places ``hots`` lists) left out."""
    before = F.coalesce(F.size(F.filter("hots", lambda h: h < F.col("pos"))), F.lit(0))
    rows = rows.join(hots, "node", "left").filter(F.col("pos") + 1 - F.greatest(before, F.lit(0)) <= _prefix(F.col("n")))
    return rows.select("token", "node", "n")


def _lengthened(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``rows`` (token, node, n) within the prefix of their set, where common shingles come last."""
    flagged = rows.join(common.withColumn("hot", F.lit(True)), "token", "left")
    order = Window.partitionBy("node").orderBy(F.coalesce("hot", F.lit(False)), "token")
    flagged = flagged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= _prefix(F.col("n")))
    return flagged.select("token", "node", "n")


def _index(docs: DataFrame, text_col: str, classes: DataFrame) -> DataFrame:
    """(token, node, n, place, component): what each set is looked up by, without shingles that one set alone has.

    One order holds for all sets: rare shingles by value, then common ones by value. A shingle alone in
    what is stored is only counted, by its place; the rows are those of the shared ones."""
    counts = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("sets"))
    counts = scratch_table(counts.filter("sets > 1"), "counts")
    rows = scratch_table(_rows_of(classes, counts), "shared")
    hots = rows.filter(F.col("sets") > HOT).groupBy("node").agg(F.collect_list("pos").alias("hots"), F.first("n").alias("n"))
    hots = scratch_table(hots, "hots")
    stored = F.least(F.col("n"), _prefix(F.col("n")) + F.floor(_prefix(F.col("n")) / 4) + 16)
    short_of = hots.filter(stored - F.size("hots") < _prefix(F.col("n"))).select("node")
    hots = hots.drop("n")
    longer = _looked_up(rows.filter(F.col("sets") <= HOT).join(short_of, "node", "left_anti"), hots)

    # the few that have too few rare shingles there look into all of theirs
    sets = _whole_sets(docs, text_col, classes, short_of)
    whole = sets.select("node", "n", F.explode("tokens").alias("token"))
    further = scratch_table(whole.select("token").distinct().join(counts, "token", "left_anti"), "further")
    longer = longer.unionByName(_looked_up(_rows_of(classes, further).join(short_of, "node", "left_anti"), hots))
    longer = scratch_table(longer, "longer")
    # of their further shingles those are common that many have and that no other set is looked up by
    common = whole.groupBy("token").count().filter(F.col("count") > HOT).select("token").join(longer, "token", "left_anti")
    common = scratch_table(common.unionByName(counts.filter(F.col("sets") > HOT).select("token")).distinct(), "common")
    looked_up = scratch_table(longer.unionByName(_lengthened(whole, common)), "index")
    drop_tables(counts, rows, hots, sets, further, longer, common)
    # a shingle's place among those its set is looked up by, most frequent first
    often = looked_up.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    order = Window.partitionBy("node").orderBy(F.desc("sets"), "token")
    placed = looked_up.join(often, "token").withColumn("place", F.row_number().over(order)).drop("sets")
    placed = scratch_table(placed.withColumn("component", F.col("node")), "index")
    drop_tables(looked_up)
    return placed


def _shared(index: DataFrame) -> DataFrame:
    """The rows of shingles whose sets lie in several components; the others can link nothing new."""
    several = index.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return scratch_table(index.join(several.filter("lo <> hi").select("token"), "token"), "index")


def _star_pairs(index: DataFrame, turn: int) -> DataFrame:
    """Pairs of each looked-up shingle's sets with two pivots among those of similar size and another component."""
    rows = index.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(1.25) + turn / 2.0))
    best = [F.min(F.struct(F.xxhash64("node", F.lit(PIVOTS * turn + k)).alias("h"), "node", "n", "place", "component"))
            for k in range(PIVOTS)]
    pivots = rows.groupBy("token", "band").agg(F.array(*best).alias("pivots"), F.min("component").alias("lo"),
                                               F.max("component").alias("hi"))
    pivots = pivots.filter("lo <> hi").select("token", "band", F.explode(F.array_distinct("pivots")).alias("pivot"))
    pairs = rows.join(pivots, ["token", "band"]).filter("component <> pivot.component")
    pairs = pairs.filter(_matches(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place")))
    return pairs.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()


def _unpaired(index: DataFrame) -> DataFrame:
    """Per shingle of several components: its largest component, its sets and those outside that component."""
    sizes = index.groupBy("token", "component").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("all"))
    largest = largest.select("token", F.col("top.component").alias("top"), "all", (F.col("all") - F.col("top.count")).alias("outside"))
    return largest.filter("outside > 0")


def _cross_pairs(index: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs in different components that share as many looked-up shingles as their sizes demand and whose parity
    bits allow it. Per shingle, one side is always outside its largest component, so that component is never paired
    with itself; a pair of different components meets once at each shingle it shares, whichever side it is on."""
    rows = index.join(_unpaired(index).select("token", "top"), "token").join(names.select("node", "bits"), "node")
    rows = scratch_table(rows, "cross")
    one = rows.filter("component <> top").select("token", F.col("node").alias("x"), F.col("n").alias("n1"),
                                                 F.col("bits").alias("b1"), F.col("component").alias("cx"))
    two = rows.select("token", F.col("node").alias("y"), F.col("n").alias("n2"), F.col("bits").alias("b2"),
                      F.col("component").alias("cy"), (F.col("component") == F.col("top")).alias("main"))
    # a pair outside the largest component meets twice; it counts once
    pairs = one.join(two, "token").filter("cx <> cy and (main or x < y)")
    pairs = pairs.filter(_may_match(F.col("n1"), F.col("b1"), F.col("n2"), F.col("b2")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), needed(F.col("n1"), F.col("n2")).alias("least"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("least").alias("least"))
    return shared.filter("shared >= least").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, each side made distinct on its own, so that no row is made per pair."""
    ends = [pairs.groupBy(F.col(side).alias("node")).agg(F.lit(1).alias("one")) for side in "ab"]
    return ends[0].unionByName(ends[1]).select("node").distinct()


def _labelled(index: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    labelled = _shared(index.drop("component").join(found, "node", "left")
                       .withColumn("component", F.coalesce("component", "node")))
    drop_tables(index)
    return labelled


def document_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_sig, the digest of its shingle set, and component,
    a number that tells components apart whose smallest doc_id is the same (null without shingles)."""
    def sets_of():
        def compute(texts):
            sets = [shingles(t) for t in texts]
            return [[len(s) for s in sets], [signature(s) for s in sets], [text_digest(t) for t in texts],
                    [parity(s) for s in sets], [s[:stored_length(len(s))] if len(s) else None for s in sets]]
        return compute
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = scratch_table(map_texts(ids, "text", ["doc_id"], "n bigint, sig binary, raw binary, bits array<bigint>, prefix array<bigint>",
                                   sets_of), "read")
    members = scratch_table(read.drop("raw", "bits", "prefix"), "members")
    classes = read.filter("n > 0").groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "raw", "bits", "prefix")])
    classes = scratch_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    drop_tables(read)

    index = _index(ids, "text", classes)
    # of the classes, only their names and parity bits are read from here on
    names = scratch_table(classes.select("node", "n", "sig", "raw", "bits"), "names")
    drop_tables(classes)
    links, sets = None, None
    before = index.groupBy("token").count().agg(F.sum(F.expr("count * (count - 1)"))).first()[0] or 0
    for turn in range(ROUNDS):
        free_driver(docs.sparkSession)
        pairs = scratch_table(_star_pairs(index, turn), "pairs")
        if turn == 0:
            # later rounds pair the same sets anew; pairs of others are left to the last step
            nodes = _ends(pairs)
            sets = _whole_sets(ids, "text", names, nodes)
        found = _verified(pairs, sets)
        drop_tables(pairs)
        links = found if links is None else links.unionByName(found)
        if not found.take(1):
            break
        index = _labelled(index, links)
        # more pivots pay as long as they halve the cost of pairing what is left, and it is above what rare lists cost
        left = _unpaired(index).agg(F.sum(F.col("outside") * F.col("all"))).first()[0] or 0
        if left <= HOT * index.count() or 2 * left > before:
            break
        before = left
    drop_tables(sets)
    free_driver(docs.sparkSession)
    pairs = scratch_table(_cross_pairs(index, names), "pairs")
    drop_tables(index)
    nodes = _ends(pairs)
    links = links.unionByName(_verified(pairs, _whole_sets(ids, "text", names, nodes)))

    free_driver(docs.sparkSession)
    # the smallest doc_id of a component, from the smallest of each class
    per_class = members.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    per_class = per_class.join(names.select("sig", "node"), "sig").join(components(links), "node", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "node"))
    lowest = per_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = scratch_table(per_class.join(lowest, "component").select("sig", "component_id", "component", "copies"), "named")
    return _attach(members, named)


def _attach(members: DataFrame, named: DataFrame) -> DataFrame:
    """Classes without copies of their own name themselves; the others are joined."""
    from raterlab.llm.common import attach_groups
    spread = F.encode(F.concat(F.lit("none"), F.monotonically_increasing_id().cast("string")), "UTF-8")
    out = attach_groups(members, named, "sig", "copies", members.count(), spread)
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.col("sig").alias("class_sig"), "component")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of linked documents, with all its columns
    (one row of it, if it is repeated); documents without shingles or id stay.

    Only documents that are not the smallest of their group are looked for, so nothing but
    ids is shuffled besides the documents' own rows. An id on several rows may have different texts:
    for these rows the decision is by the id and the digest of the row's own shingle set."""
    found = document_classes(docs, id_col, text_col).filter("doc_id is not null")
    repeated = found.groupBy("doc_id").count().filter("count > 1")
    repeated = scratch_table(repeated.select(F.col("doc_id").alias("repeated_id")), "repeated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drop = found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("drop_id")).distinct()
    lone = rows.join(repeated, rows["id"] == repeated["repeated_id"], "left_anti")
    lone = lone.join(drop, lone["id"] == drop["drop_id"], "left_anti").select("row.*")

    def sets_of():
        def compute(texts):
            sets = [shingles(t) for t in texts]
            return [[len(s) for s in sets], [signature(s) for s in sets]]
        return compute
    again = rows.join(repeated, rows["id"] == repeated["repeated_id"], "left_semi")
    again = scratch_table(map_texts(again, "text", ["row", "id"], "n bigint, sig binary", sets_of), "again")
    smallest = found.join(repeated, found["doc_id"] == repeated["repeated_id"], "left_semi")
    smallest = smallest.filter("n_shingles > 0 and doc_id = component_id")
    smallest = smallest.select(F.col("doc_id").alias("id"), F.col("class_sig").alias("sig"), F.col("component").alias("group_no")).distinct()
    kept = again.filter("n > 0").dropDuplicates(["id", "sig"]).join(smallest, ["id", "sig"]).dropDuplicates(["id", "group_no"])
    return lone.unionByName(kept.select("row.*")).unionByName(again.filter("n = 0").select("row.*"))
