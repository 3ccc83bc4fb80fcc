import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from raterlab.llm import centroids, fingerprints, prefix_trie
from raterlab.llm.ngram_join import shingles

SF = "/root/testdata/sf0.001"
CONVERSATIONS = "turn long, role string, text string, conv_id long, node string, depth int"


def brute_trie(rows):
    own = defaultdict(list)
    for turn, role, text, conv, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(int(c / 20) * 20, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, d == len(built)))
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words[p]
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted((first[p], len(p), first[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest())
                  for p, m in members.items())


def trie_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(-30, 70), 10 ** 12, 10 ** 12 + 7]:
        for t in range(rng.randrange(1, 7)):
            rows.append((t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c", "é  x\ty"]), c, "n", 1))
    rows += [(t, "user", f"deep {t // 2}", c, "n", 1) for c in (40, 45, 50) for t in range(10, 150)]  # long ones, ties with others
    rows += [(None, "user", "no turn", 3, None, None), (None, "user", "no turn", 3, None, None), (1, "user", "lost", None, None, None)]
    rows += [(t, "user", "x " * 9, 100, None, None) for t in (1, 1, 1)] + [(1, "user", "long " * 40_000, 107, None, None)]
    rows += [(0, "system", "same", c, None, None) for c in range(1000, 1100)]
    return rows


@pytest.mark.parametrize("band,hot_ends", [(4, 100_000), (2, 2), (3, 1)])
def test_prefix_trie_equals_brute_force(spark, band, hot_ends):
    rows = trie_rows()
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), band=band, hot_ends=hot_ends).drop("node").collect()
    assert sorted(tuple(r) for r in found) == brute_trie(rows)


def test_no_node_is_exploded_beyond_its_band(spark):
    rows = prefix_trie.prefixes(spark.createDataFrame(trie_rows(), CONVERSATIONS)).collect()
    for r in rows:
        step, levels = r.depth, 1
        while step and step % prefix_trie.BAND == 0:
            step, levels = step // prefix_trie.BAND, levels + 1
        assert len(r.ups) <= prefix_trie.BAND * levels and (len(r.ups) > 0) == (r.depth > 0)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z" for i, _ in kept}
    cs = [v for _, v in sorted(kept, key=lambda r: (key[r[0]], r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = defaultdict(int)
    for _, c, d in last:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest())
                   for i, c, d in last), key=str)


VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], VECTORS)
    out = centroids.cluster_vectors(df, **options)
    return sorted((tuple(r) for r in out.drop("checked").collect()), key=str), out


@pytest.mark.parametrize("spread", [0.0, 0.3, 3000.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8)) * spread
    vectors = (middles[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.05).astype(np.float32).tolist()
    rows = [*enumerate(vectors), (7, vectors[7]), (None, vectors[8]), (400, None), (401, [1.0] * 7), (402, [None] * 8),
            (403, [float("nan")] * 8), (404, [float("-inf")] * 8), (405, []), *[(500 + i, [0.0] * 8) for i in range(150)]]
    found, _ = clustered(spark, rows, k=12, rounds=4, dims=8)
    assert found == brute_clusters(rows, 12, 4, 8)


def test_few_vectors_huge_ones_and_none(spark):
    rows = [(1, [0.5] * 4), (2, [0.5] * 4), (3, [-1.25] * 4)]
    assert clustered(spark, rows, k=9, dims=4)[0] == brute_clusters(rows, 9, 5, 4)
    assert clustered(spark, [], k=9, dims=4)[0] == [] and clustered(spark, [(1, None)], k=9, dims=4)[0] == []
    huge = clustered(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], k=1, rounds=1)[0]
    assert [r[2] for r in huge] == [64 * (1 << 54)] * 2


def test_bounds_spare_distances_and_never_exceed_them(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    checked = [r.checked for r in centroids.cluster_vectors(df).select("checked").collect()]
    assert len(checked) == 2000 and np.mean(checked) < 0.3 * centroids.K
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (200, 16))
    history = [rng.integers(-300, 300, (5, 16)) for _ in range(3)]
    pivots = centroids.Pivots(history, history[0] * centroids.FAR + 1)
    since = rng.integers(0, 3, (200, 5)).astype(np.uint8)
    true = centroids._distances(v, history[-1])
    near = np.stack([centroids._distances(v, h) for h in history])[since, np.arange(200)[:, None], np.arange(5)].astype(np.float32)
    far = centroids._distances(v, pivots.partners).astype(np.float32)
    bounds = pivots.bounds(far, near, since)
    assert (bounds <= true * (1 + 1e-12)).all() and bounds.max() > 0
    unmoved = pivots.bounds(far, true.astype(np.float32), np.full((200, 5), 2))
    assert np.allclose(unmoved, true, rtol=1e-4)


def jaccard(a, b):
    a, b = set(shingles(a).tolist()), set(shingles(b).tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_fingerprint(text, bins, bits):
    """The rule written out bin by bin."""
    held = {}
    for h in sorted(shingles(text).view(np.uint64).tolist(), reverse=True):
        held[h // (2 ** 64 // bins)] = h % 2 ** bits
    if not held:
        return ""
    order, _ = fingerprints._orders(bins)
    values = [held[b] if b in held else held[next(o for o in order[b].tolist() if o in held)] for b in range(bins)]
    return "".join(f"{sum(v << bits * (8 // bits - 1 - j) for j, v in enumerate(values[i:i + 8 // bits])):02x}"
                   for i in range(0, bins, 8 // bits))


def test_fingerprint_follows_its_rule():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 9, 35, 36, 37, 60, 400, 3000):
        text = " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n))
        for bins, bits in ((512, 4), (64, 1), (64, 2), (16, 8)):
            assert fingerprints.fingerprint(text, bins, bits).hex() == plain_fingerprint(text, bins, bits)


def test_successors_equal_brute_force(spark, docs, no_docs):
    given = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = fingerprints.compare_successors(spark.read.parquet(f"{SF}/documents.parquet"))
    found = {r.doc_id: r for r in found.repartition(3).collect()}
    given.sort()
    assert len(found) == len(given)
    errors = []
    for (doc, text), (_, after) in zip(given, given[1:] + given[:1]):
        cut = len(text) // 2
        other = text[:len(text) - cut] + after[:cut]
        r = found[doc]
        one, two, three = (plain_fingerprint(t, fingerprints.BINS, fingerprints.BITS) for t in (text, other, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one, two)
        assert r.near_edited == fingerprints.likeness(bytes.fromhex(one), bytes.fromhex(two))
        assert r.near_next == fingerprints.likeness(bytes.fromhex(one), bytes.fromhex(three))
        errors += [r.near_edited - jaccard(text, other), r.near_next - jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.01 and np.mean(np.abs(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    # nulls first, one document per row, ties by hash of text, one or no document
    rows = [tuple(r) for r in fingerprints.compare_successors(docs).collect()]
    assert len(rows) == docs.count() and sum(r[0] == 6 for r in rows) == 2
    null, first, last = (next(r for r in rows if r[0] == d) for d in (None, 1, 8))
    assert null[2] == hashlib.sha256(b"no idAlpha").hexdigest()
    assert last[2] == hashlib.sha256(fingerprints.edited("é É <|endoftext|> 's 123  x", "no id here").encode()).hexdigest()
    assert (first[6], next(r for r in rows if r[0] == 3)[3:]) == (1.0, ("", "", 1.0, 1.0))
    one = fingerprints.compare_successors(docs.filter("doc_id = 1")).collect()
    assert one[0].edited_sha256 == hashlib.sha256("Alpha beta gamma del".ljust(18)[:18].encode() + b"Alpha beta gamma "[:17]).hexdigest()
    assert fingerprints.compare_successors(no_docs).collect() == []
    kept = fingerprints.fingerprints(docs, ["doc_id", "source"]).filter("doc_id = 1").first()
    assert (kept.source, kept.fingerprint) == ("a", first[3])
