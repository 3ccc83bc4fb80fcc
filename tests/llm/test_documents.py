import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from raterlab.llm import exact_dedup, mixing, ngram_join, toxicity


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_exact_duplicates(docs, no_docs):
    out = exact_dedup.exact_duplicates(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lowered(r.text)].append(r.doc_id)
    assert len(out) == docs.count() and sum(r.kept for r in out) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = exact_dedup.drop_duplicates(docs.withColumn("fp", docs["size"]).withColumn("row", docs["size"]))
    assert kept.columns == [*docs.columns, "fp", "row"]
    assert sorted((lowered(r.text) for r in kept.collect())) == sorted(groups)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 == exact_dedup.drop_duplicates(no_docs).count()


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out} == {
        i: (2997, 1000, i == 2997) if i % 3 == 0 else (i, 1, True) for i in range(3000)}


def test_mixing_comes_near_its_targets(spark, docs, no_docs):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(0, 40), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    total = sum(r["size"] for r in out)
    taken, per = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        per[r.source] = (r.source_size, r.target)
        assert r.taken in [r["size"] * k for k in range(4)]
    # by hand: cap at three times the size, share what is over by weight, until none is above
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s][0]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * per[s][0] for s in over}
        free -= over
    for s in names:
        assert abs(per[s][1] - want[s]) < 1e-6 * total and abs(taken[s] - want[s]) <= 40
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(9)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    copies = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.copies for r in out if r.copies}
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(docs).count() == docs.count()
    assert mixing.mixed_documents(docs.withColumn("epochs", docs["size"])).columns == [*docs.columns, "epochs"]


def brute_components(rows):
    sets, holders = {}, defaultdict(list)
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for s in sets[d]:
            holders[s].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in holders[x]:
                common[e] += 1
        for e, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base, passage, rows = [rnd.choice(words) for _ in range(120)], [rnd.choice(words) for _ in range(30)], []

    def add(w):
        rows.append((len(rows) * 3 + 1, " ".join(w)))
    for _ in range(50):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        add(w)
    for _ in range(30):
        add([rnd.choice(words) for _ in range(rnd.randrange(5, 40))] + passage)
        add(passage + [rnd.choice(words) for _ in range(rnd.randrange(0, 10))])
        add([rnd.choice(words) for _ in range(rnd.randrange(0, 4))])
    for _ in range(10):
        add(base)
    return rows + [(9001, None), (9002, ""), (9003, " \t"), (9004, "A b"), (9005, "a  B")]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(ngram_join, "HOT", 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngram_join.document_classes(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_parity_bits_differ_at_most_as_sets_do():
    rnd = random.Random(11)
    for size in (0, 1, 5, 90, 600, 5000):
        base = [rnd.getrandbits(63) for _ in range(size)]
        one = {x for x in base if rnd.random() < 0.9} | {rnd.getrandbits(63) for _ in range(size // 9)}
        two = {x for x in base if rnd.random() < 0.9} | {rnd.getrandbits(63) for _ in range(size // 7)}
        bits = [ngram_join.parity(np.array(sorted(x), dtype=np.int64)) for x in (one, two)]
        apart = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        assert apart <= len(one ^ two) and (apart - len(one ^ two)) % 2 == 0
        assert not (bits[0] ^ ngram_join.parity(np.array(sorted(one), dtype=np.int64))).any()


def test_near_copies_that_are_not_similar_are_not_verified(spark, monkeypatch):
    """400 copies of one text, each with words of its own: all shingles that they share are common, most pairs are below 0.8."""
    rnd = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for d in range(400):
        w = list(base)
        for i in rnd.sample(range(150), rnd.randrange(1, 6)):
            w[i] = f"own{d}x{i}"
        rows.append((d, " ".join(w)))
    seen = []
    verified = ngram_join._verified

    def counted(pairs, sets):
        links = verified(pairs, sets)
        seen.append((pairs.count(), links.count()))
        return links
    monkeypatch.setattr(ngram_join, "_verified", counted)
    out = ngram_join.document_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)
    pairs, links = seen[-1]
    assert pairs <= 2 * links + 400, seen


def test_one_document_of_each_group_stays(docs, no_docs):
    kept = ngram_join.one_per_group(docs.withColumn("component", docs["size"]))
    assert kept.columns == [*docs.columns, "component"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]
    assert ngram_join.document_classes(no_docs).count() == 0


def test_one_id_on_different_texts(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")),
            (4, text("e")), (4, text("e") + " more"), (2, ""), (5, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text[:2]) for r in ngram_join.one_per_group(df).collect())
    assert kept == [(1, "a0"), (2, ""), (2, "b0"), (3, "c0"), (3, "d0"), (4, "e0"), (5, "f0")]


def test_restoring_hidden_words():
    import numpy as np
    text = "the loser and the moron met a clown who was a stupid idiot in the trash of scum " * 30
    table = np.zeros(toxicity.SYMBOLS ** 3)
    k = [0] + [toxicity.INDEX.get(c, 0) for c in text] + [0]
    for a, b, c in zip(k, k[1:], k[2:]):
        table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    model = toxicity.log_probabilities(table)
    for hidden, word in [("l0ser", "loser"), ("m0r0n", "moron"), ("$cum", "scum"), ("tr@sh", "trash"), ("stuuupid", "stupid"),
                         ("c l o w n", "clown"), ("1di0t", "idiot"), ("trash***", "trash"), ("clown,", "clown")]:
        assert toxicity.restore(hidden, model) == [word], hidden


def character_model():
    import numpy as np
    text = "the loser and the moron met a clown who was a stupid idiot in the trash of scum " * 30
    table = np.zeros(toxicity.SYMBOLS ** 3)
    k = [0] + [toxicity.INDEX.get(c, 0) for c in text] + [0]
    for a, b, c in zip(k, k[1:], k[2:]):
        table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    return toxicity.log_probabilities(table)


def test_hidden_words_in_long_chunks():
    model = character_model()
    spaced = " ".join("theloserandthemoronmetaclownwhowasa" * 8)
    joined = "_".join(["the_m0r0n_met_a_cl0wn_and_the_l0ser_was_an_1d10t"] * 12)
    assert len(spaced) > 500 < len(joined)
    for text, words in [(spaced, {"loser", "moron", "clown"}), (joined, {"loser", "moron", "clown"})]:
        found = {w for c in toxicity.chunks(text) for w in toxicity.restore(c, model)}
        assert words <= found, sorted(found)
    # as in a short chunk, and without a bound on the length
    assert toxicity.restore("_".join(["1d10t"] * 20_000), model) == ["idiot"] * 20_000


def test_hidden_words_at_edges_of_signs_doubled_and_spaced():
    import numpy as np
    text = "the clown and the idiot met a stupid dumbass who said shit to a moron with boobs and gave his ass a kiss " * 30
    table = np.zeros(toxicity.SYMBOLS ** 3)
    k = [0] + [toxicity.INDEX.get(c, 0) for c in text] + [0]
    for a, b, c in zip(k, k[1:], k[2:]):
        table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    model = toxicity.log_probabilities(table)
    for hidden, word in [("dumba$$", "dumbass"), ("ki$$", "kiss"), ("$$tupid", "stupid"), ("(lown", "clown"), ("455", "ass"),
                         ("4$$", "ass"), ("$#!7", "shit"), ("80085", "boobs"), ("iiddiioott", "idiot"), ("ssttuuppiidd", "stupid"),
                         ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("i\u00a0d \ni\u00a0o t", "idiot"),
                         ("m  o r\t\to n", "moron"), ("(clown)", "clown"), ("moron$$$", "moron"), ("kiss", "kiss")]:
        found = {w for c in toxicity.chunks(hidden) for w in toxicity.restore(c, model)}
        assert word in found, (hidden, found)
    words = [w for c in toxicity.chunks("t h e  m o r o n") if " " in c for w in toxicity.restore(c, model)]
    assert words == ["the", "moron"]
    assert toxicity.restore("$$$", model) == toxicity.restore("---", model) == []


def test_toxicity_learns_from_labels_outside_the_fold(spark, docs, no_docs):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["fine", "good", "day", "tree", "stone", "river"]) for _ in range(20))
             + (" scumbag" if i % 4 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.toxicity(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_a_large_filter_reaches_the_driver_as_arrays(spark):
    import tracemalloc

    from pyspark.sql import functions as F
    from raterlab.llm.common import MAX_FILTER_WORDS, member_bits, test_bits
    keys = spark.range(0, 4 * MAX_FILTER_WORDS, 1, 4).select(F.xxhash64("id").alias("key"))
    tracemalloc.start()
    bits, words = member_bits(keys, "key")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == MAX_FILTER_WORDS and len(bits) == 8 * words
    assert peak < 6 * len(bits)
    some = keys.limit(1000).toPandas()["key"].to_numpy()
    assert test_bits(bits, words, some).all()
    empty, few = member_bits(keys.filter("key is null"), "key")
    assert not test_bits(empty, few, some).any()
