import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tickloom.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def same(texts):
    model = sp.piece_model(PATH)
    for text, (n, joined, decoded), ids in zip(texts, model.coded(texts), LIBRARY.encode(texts, num_threads=1), strict=True):
        assert (n, joined.decode()) == (len(ids), ",".join(map(str, ids))), text[:80]
        assert decoded.decode() == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", [
    "", " ", "a", "aaaaaaaaaaa", "  two  spaces  ", " " * 37, "x" + " " * 50 + "y", "▁x▁▁ ▁", "<s> </s> <unk> <0x0A>", "\n\t\r\x00", "日本語 テスト ½ ² é 😀",
    "abab" * 300, "3.14159 2,718", "ﬁ ́ ﻿ ​ �", "don't DON'T", "İ Σ ς", "😀" * 700, "ab " * 400,
])
def test_ids_and_text_equal_the_library(text):
    same([text])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=50) | st.text(alphabet=" ▁aeintrs\n", max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    same(texts)


def test_words_by_rounds_and_by_places_agree():
    rng = random.Random(2)
    model = sp.PieceModel(PATH)
    words = ["".join(rng.choice("▁aeinrstho") for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["▁" * k for k in range(1, 70)]
    flat, sizes = model.merge_words(words)
    assert flat.tolist() == [s for word in words for s in model._long(word).tolist()] and len(sizes) == len(words)


def test_every_pair_is_found_and_no_other():
    model, rng = sp.piece_model(PATH), np.random.default_rng(7)
    left, right = (np.array([k >> shift & (1 << 20) - 1 for k in model.pairs], np.int64) for shift in (20, 0))
    at = model.table.find(left, right)
    assert [(r, m) for r, m in zip(model.table.ranks[at].tolist(), model.table.merged[at].tolist())] == list(model.pairs.values())
    left, right = rng.integers(-5, 32000, 100_000), rng.integers(-5, 32000, 100_000)
    want = [model.pairs.get(a << 20 | b, (int(sp._NONE),))[0] if min(a, b) >= 0 else int(sp._NONE) for a, b in zip(left.tolist(), right.tolist())]
    assert model.table.ranks[model.table.find(left, right)].tolist() == want


def test_long_unbroken_text_costs_what_it_touches():
    rng = random.Random(5)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000)), " " * 30_000, "ab" * 60_000, "日本語" * 20_000):
        start = time.perf_counter()
        same([text])
        assert time.perf_counter() - start < 5


def test_decoding_any_ids():
    rng = random.Random(6)
    model = sp.piece_model(PATH)
    for _ in range(200):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 20))]
        assert model.decode(ids) == LIBRARY.decode(ids)


def test_awkward_rows(awkward):
    rows = sp.encode_pieces(awkward, keep=True).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i)), tuple(i)) for i in LIBRARY.encode(texts)]
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in rows) == sorted(want)
    assert all(sha(r["decoded"]) == r["decoded_sha256"] for r in rows)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in awkward.collect())


def test_empty_table(nothing):
    assert sp.encode_pieces(nothing).collect() == []
