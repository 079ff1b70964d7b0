import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", [
    "", "a", "aaaaaaaaa", "aa" * 700, "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y", "  \n\n  x y z \x1c\x1d q",
    "日本語 テスト ½ ² ٣ é 😀", "don't we'll 'S 's", "...!!!   ", "abcab" * 900, "İ Σ ς ſ", "\x00\x01",
])
def test_counts_equal_the_library(text):
    assert tc.RankMerger(PATH).count_texts([text]) == library([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    assert tc.merger(PATH).count_texts(texts) == library(texts)


def test_forgetting_keeps_counts_right(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    merger = tc.RankMerger(PATH)
    texts = ["one two three four five", "six seven", "one two nine ten eleven twelve"]
    assert merger.count_texts(texts) == library(texts) and merger.count_texts(texts[:1]) == library(texts[:1])


def test_long_unbroken_runs_cost_what_they_touch():
    import random
    import time

    rng = random.Random(4)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000)), "a" * 160_000, "ab" * 50_000, "日本語" * 20_000):
        start = time.perf_counter()
        got = tc.merger(PATH).count_texts([text])
        assert time.perf_counter() - start < 4
        assert got == library([text])


def test_awkward_rows(awkward):
    rows = tc.token_counts(awkward, limit=5).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    assert sorted((len(t.encode()), n, n > 5) for t, n in zip(texts, library(texts), strict=True)) == sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)


def test_empty_table(nothing):
    assert tc.token_counts(nothing).collect() == []
