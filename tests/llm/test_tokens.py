import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from raterlab.llm import bpe, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rnd = random.Random(7)
    pick = [lambda: chr(rnd.randrange(0, 127)), lambda: chr(rnd.randrange(0x80, 0x600)), lambda: " ", lambda: "\n",
            lambda: chr(rnd.randrange(0x600, 0xD7FF)), lambda: chr(rnd.randrange(0x10000, 0x1FFFF)), lambda: "a", lambda: "'"]
    out = ["", "a" * 3000, "abcdefghij" * 300, "<|endoftext|> hi<|startoftext|>x", "ΑΣ ΟΔΟΣ İ ﬁ é\x1c\x85x", "a!\x1c!b", "I'LL don't"]
    return out + ["".join(rnd.choice(pick)() for _ in range(rnd.randrange(1, 50))) for _ in range(800)]


def test_encoding_and_decoding_equal_the_library():
    lib, own = Tokenizer.from_file(WORD), bpe.Encoder(bpe.read_vocabulary(WORD))
    for t in odd_texts():
        want = lib.encode(t, add_special_tokens=False).ids
        assert bpe.unpack(own.encode(t)) == want
        assert own.decode(own.encode(t)) == lib.decode(want, skip_special_tokens=False)


def test_array_and_heap_merge_alike():
    own = bpe.Encoder(bpe.read_vocabulary(WORD))
    rnd = random.Random(3)
    for _ in range(100):
        data = "".join(rnd.choice("abehint") for _ in range(rnd.randrange(1, 400))).encode()
        ids = [own.inner[b] for b in data[:-1]] + [own.last[data[-1]]]
        assert bpe.merge_short(list(ids), own.merges)[0] == bpe.merge_long(list(ids), own.merges)


def test_counts_equal_the_library():
    lib, own = Tokenizer.from_file(BYTE), token_counts.Counter(bpe.read_vocabulary(BYTE))
    texts = odd_texts()
    assert own.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_vocabularies_with_word_ends_are_rejected():
    with pytest.raises(ValueError):
        token_counts.Counter(bpe.read_vocabulary(WORD))


def test_tables(docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    out = token_counts.token_counts(docs, bpe.read_vocabulary(BYTE), ["doc_id", "size"]).collect()
    want = sorted((len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) and r["size"] == 7 for r in out)
    assert token_counts.token_counts(no_docs, bpe.read_vocabulary(BYTE), ["doc_id"]).count() == 0
    # a kept column named like a result is replaced
    clash = docs.withColumn("ids", docs["size"])
    coded = bpe.encode_decode(clash, bpe.read_vocabulary(WORD), ["doc_id", "ids"])
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"] and coded.count() == docs.count()
