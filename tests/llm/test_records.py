import hashlib
import random

from raterlab.llm import chat_format, topk, url_filters, warc


def test_archive_round_trip(spark, tmp_path):
    big = "x" * 150
    pages = [(3, "http://a/\r\nb", big), (2, None, big), (2, None, big), (5, "u", "small"), (4, "u", "small"), (6, "u", None),
             (None, "n", big), (7, "é", "ü" * 3000)] + [(100 + i, "http://h/", f"{i} " * 200) for i in range(40)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, bytes string")
    outs = []
    for name in ("one", "two"):
        manifest = warc.write_archive(df.repartition(5), str(tmp_path / name), roll_bytes=2000, shard_bytes=4000)
        outs.append(sorted((r.file, r.sha256) for r in manifest.collect()))
    assert outs[0] == outs[1] and len(outs[0]) > 3  # the same bytes whatever the partitions
    got = warc.read_archive(spark, str(tmp_path / "one"), payloads=True).collect()
    assert len(got) == len(pages)
    payload = {(p, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h in pages}
    for r in got:
        data = payload[r.page_id, r.payload_digest]
        assert r.payload_bytes == len(data) and (r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 150)
    assert kinds == [("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 2), ("None", "revisit", 2)]
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    warc.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_any_turns_come_back():
    rnd = random.Random(2)
    parts = chat_format.CONTROLS + ["\\", " ", "a", "<", "[INST", "]", "\n", ""]
    for _ in range(1500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a [:] b"]),
                  "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 6)))) for _ in range(rnd.randrange(1, 4))]
        text, loss = chat_format.format_turns(turns)
        assert chat_format.parse(text, True) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", 50)
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "\\</s> yes"), (2, 5, "user", None), (2, None, None, "x"),
            (None, 0, "assistant", "[INST]"), *[(3, i, "user" if i % 2 == 0 else "assistant", "é" * 30) for i in range(50)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat_format.read_conversations(chat_format.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        turns = [(role or "", text or "") for _, _, role, text in
                 sorted((x for x in rows if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_conversations(chat_format.format_conversations(df.limit(0))).count() == 0


def archived(spark, df, where, **options):
    manifest = warc.write_archive(df, where, **options).orderBy("file").collect()
    return manifest, warc.read_archive(spark, where, payloads=True).collect()


PAGES = "page_id long, url string, html string"


def test_pages_without_id_keep_their_payload(spark, tmp_path):
    long, other = "x" * 150, "y" * 150
    rows = [(None, "a", long), (None, "b", long), (None, "c", long), (None, "d", other), (9, "e", other), (4, "f", other),
            (None, "g", "short"), (None, "h", "short"), (None, None, None)]
    for part in (rows[:3], rows, [*rows, *rows]):
        _, got = archived(spark, spark.createDataFrame(part, PAGES).repartition(3), str(tmp_path / str(len(part))))
        assert len(got) == len(part)
        of = {t: [r for r in got if r.payload_digest == hashlib.sha256(t.encode()).hexdigest()] for t in (long, other, "short")}
        assert [r.payload for r in of[long] if r.record_type == "response"] == [long.encode()]
        assert {(r.record_type, r.refers_to) for r in of[long]} == {("response", None), ("revisit", None)}
        if len(part) > 3:
            assert [(r.page_id, r.payload) for r in of[other] if r.record_type == "response"] == [(4, other.encode())]
            assert {r.refers_to for r in of[other] if r.record_type == "revisit"} == {4}
            assert {r.record_type for r in of["short"]} == {"response"}


def test_shards_follow_the_ids(spark, tmp_path):
    """An outlying id does not put all others into one shard, and one heavy id or null ids are split by payload."""
    ids = [*range(300), 2 ** 62, -2 ** 63, *[7] * 100, *[None] * 100]
    rows = [(i, "u", f"{n} " + "z" * 300) for n, i in enumerate(ids)]
    manifest, got = archived(spark, spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), shard_bytes=16_000)
    assert sorted((str(r.page_id), r.payload) for r in got) == sorted((str(i), h.encode()) for i, _, h in rows)
    per = {}
    for m in manifest:
        per[m.shard] = per.get(m.shard, 0) + m.records
    assert sum(per.values()) == len(rows) and max(per.values()) <= 2 * 16_000 // 800 and len(per) < 200
    names = [m.file for m in manifest]
    assert names == sorted(names) and len(set(names)) == len(names)


def test_an_archive_written_again_is_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}", f"{i % 50} " * 100) for i in range(200)], PAGES)
    where = str(tmp_path / "a")
    first, got = archived(spark, rows, where, shard_bytes=9_000, roll_bytes=700)
    (tmp_path / "a" / f".{first[0].file}.feed.tmp").write_bytes(b"left by a lost attempt")
    files = {f.name: f.read_bytes() for f in (tmp_path / "a").glob("pages-*")}
    again, back = archived(spark, rows.repartition(7), where, shard_bytes=9_000, roll_bytes=700)
    assert again == first and sorted(back) == sorted(got)
    assert {f.name: f.read_bytes() for f in (tmp_path / "a").glob("pages-*")} == files
    assert not list((tmp_path / "a").glob(".*.tmp"))


def test_top_k_makes_fewer_products_than_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = 40 * (df.count() - 1)
    assert 0 < topk.products_made(df, "vec_id % 50 = 0") < 0.25 * pairs


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) * (1 + i % 3) for _ in range(6)]) for i in range(300)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [0.0] * 6),
             (650, [1.0, 2.0]), (651, []), (50, rows[50][1]), (None, [9.0] * 6), *[(700 + i, [3.0] * 6) for i in range(20)]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    import numpy as np
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(good) if a != b)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, "vec_id % 50 = 0").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_dated_lists(spark):
    import datetime as dt
    day = lambda s: dt.date.fromisoformat(s)
    entries = [("host:a.b.com", day("2024-01-10"), "block"), ("host:a.b.com", day("2024-03-01"), "delist"),
               ("domain:b.com", day("2024-02-01"), "allow"), ("path:a.b.com/x", day("2024-02-15"), "allow"),
               ("path:a.b.com/x", day("2024-02-15"), "block"), (None, day("2024-01-01"), "block"), ("host:z", None, "block")]
    captures = [(1, "https://A.b.com/x/1", day("2024-01-09")), (2, "https://a.b.com/y", day("2024-01-10")),
                (3, "http://u@a.b.com:80/x?q", day("2024-02-20")), (4, "http://a.b.com", day("2024-03-01")),
                (4, "http://a.b.com", day("2024-03-01")), (5, None, day("2024-03-01")), (6, "http://a.b.com", None), (7, "junk", day("2024-03-01"))]
    c = spark.createDataFrame(captures, "id long, url string, day date").withColumnRenamed("day", "rule")
    e = spark.createDataFrame(entries, "key string, listed_on date, action string")
    out = url_filters.decide(c.withColumnRenamed("rule", "day"), e, "id", "url", "day").collect()
    got = sorted((r.id, r.rule, r.decision, r.kept) for r in out if r.rule) + sorted(r.id for r in out if not r.rule and r.kept)
    assert got == [(2, "host:a.b.com", "block", False), (3, "path:a.b.com/x", "block", False),
                   (4, "domain:b.com", "allow", True), (4, "domain:b.com", "allow", True), 1, 5, 6, 7]
    assert url_filters.decide(c.withColumnRenamed("rule", "day"), e.limit(0), "id", "url", "day").filter("kept").count() == 8
