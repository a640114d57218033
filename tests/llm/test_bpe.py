"""BPE codec and token counts against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from modelwatch.llm import bpe, token_counts
from modelwatch.llm.queries import tokenizer_path
from tests.llm.cases import AWKWARD, awkward, empty, table

LETTERS = list("abcdeéñßüÇ'  \n\t.,!?<>|123½²٣漢ǅΣσς́  \x1c\x85İ\U0001f642") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", " the", "aaaa"]


def _random_texts(n, seed=3):
    rnd = random.Random(seed)
    return (["".join(rnd.choices(LETTERS, k=rnd.randint(0, 40))) for _ in range(n)]
            + ["".join(chr(rnd.choice([rnd.randint(0, 0x250), rnd.randint(0, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)]))
                       for _ in range(30)) for _ in range(n // 4)]
            + ["a" * 20_000, "ab" * 3000, " " * 1000, "", "x  y \n z", "-" * 777])


@pytest.fixture(scope="module")
def byte_path():
    return tokenizer_path("byte_bpe_50k.json")


def test_codec_equals_library(byte_path):
    want, codec = Tokenizer.from_file(byte_path), bpe.load(byte_path)
    for text in _random_texts(3000):
        ids = codec.encode(text)
        expected = want.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert codec.decode(ids) == want.decode(expected, skip_special_tokens=False)


def test_decode_of_broken_bytes(byte_path):
    want, codec = Tokenizer.from_file(byte_path), bpe.load(byte_path)
    rnd = random.Random(1)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(8)]
        import numpy as np
        assert codec.decode(np.array(ids, np.uint32)) == want.decode(ids, skip_special_tokens=False)


def test_tables_of_encoded_strings_stay_bounded(byte_path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    want, codec = Tokenizer.from_file(byte_path), bpe.Codec(byte_path)
    for text in _random_texts(300, 9):
        assert codec.encode(text).tolist() == want.encode(text, add_special_tokens=False).ids
        assert max(len(codec.piece), len(codec.later), len(codec.alone)) <= 51


def test_round_trip_rows(spark, byte_path):
    want = Tokenizer.from_file(byte_path)
    docs = awkward(spark)
    rows = bpe.round_trip(docs, byte_path).collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = want.encode(r["text"] or "", add_special_tokens=False).ids
        text = want.decode(ids, skip_special_tokens=False)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert bpe.round_trip(empty(spark), byte_path).count() == 0


def test_encode_then_decode_gives_the_text(spark, byte_path):
    docs = awkward(spark).drop("ids")
    back = bpe.decode(bpe.encode(docs, byte_path), byte_path)
    assert set(back.columns) == {*docs.columns, "ids", "lossless", "decoded"}
    assert sorted(r["decoded"] for r in back.collect()) == sorted(t or "" for t in AWKWARD)


def test_token_counts_equal_library(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "COMMON_ROWS", 40)  # most pre-tokens go through the join
    docs = table(spark, _random_texts(400) + ["<|endoftext|>x<|startoftext|>"]).unionByName(awkward(spark).select(
        "doc_id", "text", "lang", "source", "n_chars"))
    got = token_counts.token_counts(docs, path, limit=20).collect()
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(want.encode(text, add_special_tokens=False).ids)
        expected.append((r["doc_id"], len(text.encode()), n, n > 20))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_token_counts_of_awkward_and_empty_tables(spark):
    path = tokenizer_path("word_bpe_49k.json")
    assert token_counts.token_counts(awkward(spark), path).count() == len(AWKWARD)
    assert token_counts.token_counts(empty(spark), path).count() == 0
