"""The registered training-data queries and the pipeline on small tables, as they are run."""
import hashlib
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from raterlab.llm import queries
from raterlab.llm.ngram_join import shingles

SF = "/root/testdata/sf0.001"
PER_DOCUMENT = {"op1_bpe", "op2_ngram_join", "op4_toxicity", "op7_mix", "op9_token_counts", "op10_exact_dedup", "op13_fingerprints"}


def documents(spark, where=SF):
    return {r.doc_id: r for r in spark.read.parquet(f"{where}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_queries_return_every_document(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(documents(spark))


def test_digests_of_encoding_and_counting(spark):
    docs = documents(spark)
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bytes_ = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for tokenizer in (words, bytes_):
        tokenizer.no_truncation(), tokenizer.no_padding()
    for r in queries.op1_bpe(spark, SF).collect():
        ids = words.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = words.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for r in queries.op9_token_counts(spark, SF).collect():
        n = len(bytes_.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)


def test_digests_of_chats(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    found = {r.conv_id: r for r in queries.op6_chat_format(spark, SF).collect()}
    assert set(found) == set(turns)
    for c, held in turns.items():
        said = "".join(t for role, t in held if role == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256) == (len(held), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in held).encode()).hexdigest())
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def similar(a, b):
    both = len(a & b)
    return bool(a) and 100 * both >= 80 * len(a | b)


def near(texts):
    """The smallest id of each document's component, by comparing all pairs."""
    sets = {i: set(shingles(t).tolist()) for i, t in texts.items()}
    lowest = {i: i for i in sets}

    def top(i):
        while lowest[i] != i:
            i = lowest[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                x, y = sorted((top(i), top(j)))
                lowest[y] = x
    return {i: top(i) for i in sets}


def test_near_copies_as_registered(spark):
    expected = near({i: r.text or "" for i, r in documents(spark).items()})
    assert {r.doc_id: r.component_id for r in queries.op2_ngram_join(spark, SF).collect()} == expected


def test_pipeline_stages_take_effect(spark):
    """Each stage against brute force on what the stage before kept."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    all_docs = documents(spark)
    verdict = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, SF).collect()}
    clean = {i: all_docs[i].text or "" for i, toxic in verdict.items() if not toxic}
    assert sorted(r.doc_id for r in kept["toxicity"]) == sorted(clean) and len(clean) < len(all_docs)
    last = {}
    for i in sorted(clean):
        last[re.sub("[A-Z]", lambda m: m.group().lower(), clean[i])] = i
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(last.values())
    component = near({i: clean[i] for i in last.values()})
    assert sorted(r.doc_id for r in kept["ngram_join"]) == sorted({c for c in component.values()})
    mixed = [r.doc_id for r in kept["mixing"]]
    assert set(mixed) <= set(component.values()) and max(map(mixed.count, set(mixed))) <= 3
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words.no_truncation(), words.no_padding()
    assert sorted(r.doc_id for r in kept["bpe"]) == sorted(mixed)
    for r in kept["bpe"]:
        ids = words.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_pipeline_with_nulls_repeats_and_nothing(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = real.limit(30)
    odd = spark.createDataFrame([(10 ** 6, None, None, None, None), (None, "no id at all", "en", "s", 3), (10 ** 6 + 1, "", "en", None, 0),
                                 (10 ** 6 + 2, "same words here", "en", "s", 1), (10 ** 6 + 2, "same words here", "en", "s", 1)], real.schema)
    for name, docs in (("odd", some.unionByName(odd)), ("none", real.limit(0))):
        where = str(tmp_path / name)
        docs.write.parquet(os.path.join(where, "documents.parquet"))
        labels.write.parquet(os.path.join(where, "labels.parquet"))
        out = corpus_pipeline.run(spark, where).collect()
        ids = [r.doc_id for r in out]
        assert name == "odd" or not out
        assert name == "none" or 10 ** 6 + 2 in ids or len(ids) > 0
