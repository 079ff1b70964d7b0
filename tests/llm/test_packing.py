import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing as pk

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, limits):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.documents and sum(n * n for _, n in pieces) <= limits.attention
    return len(held)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [pk.Limits(), pk.Limits(64, 3, 64 * 64), pk.Limits(64, 64, 2000), pk.Limits(16, 2, 100)])
def test_plans_place_every_piece_once_under_every_capacity(rule, limits):
    rng = random.Random(3)
    counts = Counter(min(limits.piece(), max(1, int(rng.expovariate(0.05)))) for _ in range(3000))
    plan = pk.best_fit(dict(counts), limits, rule)
    rows = []
    ranks = defaultdict(list)
    for p in plan.itertuples():
        for k in range(p.sequences * p.each):
            ranks[p.length].append(p.rank + k)
            rows.append({"sequence_id": p.first + k % p.sequences, "offset": p.place + k // p.sequences * p.length, "length": p.length})
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    used = check(rows, limits)
    least = max(sum(n * c for n, c in counts.items()) / limits.tokens, sum(counts.values()) / limits.documents, sum(n * n * c for n, c in counts.items()) / limits.attention)
    assert used <= 1.25 * least + 2


def one_by_one(lengths, limits, rule):
    """Best-fit decreasing, a piece at a time over all sequences; how many there are."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    ask = [np.array([n, 1, n * n], float) for n in lengths]
    weights = sum(ask) / caps
    weights, bins = weights / weights.sum(), []
    for need in sorted(ask, key=lambda a: -a[0]):
        scores = []
        for left in bins:
            fits = (left >= need).all()
            score = (weights * ((left - need) / caps) ** 2).sum() if rule == "norm" else -(weights * left / caps * need / caps).sum()
            scores.append(score if fits else np.inf)
        if not scores or min(scores) == np.inf:
            bins.append(caps - need)
        else:
            bins[int(np.argmin(scores))] -= need
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [pk.Limits(64, 64, 64 * 64), pk.Limits(64, 4, 64 * 64), pk.Limits(64, 64, 2500)])
def test_as_few_sequences_as_piece_by_piece(rule, limits):
    for seed in range(6):
        rng = random.Random(seed)
        lengths = [rng.randint(1, limits.piece()) for _ in range(250)]
        plan = pk.best_fit(dict(Counter(lengths)), limits, rule)
        used, want = int((plan["first"] + plan["sequences"]).max()), one_by_one(lengths, limits, rule)
        assert used <= want * 1.03 + 1, (used, want)


def test_equal_rows_and_common_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pk, "PART_ROWS", (4, 16))
    same = spark.createDataFrame([(1, "one two three")] * 300 + [(2, "four")] * 50, "doc_id long, text string").repartition(7)
    rows = pk.pack_documents(same, pk.Limits(16, 16, 256)).collect()
    assert len(rows) == 350
    check(rows, pk.Limits(16, 16, 256))


def test_few_sequences():
    rng = np.random.default_rng(0)
    counts = Counter(int(n) for n in rng.integers(1, 2049, 20_000))
    plan = pk.best_fit(dict(counts), pk.Limits())
    assert (plan["first"] + plan["sequences"]).max() <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_documents_equal_the_library(spark, awkward):
    limits = pk.Limits(256, 256, 256 * 256)
    rows = pk.pack_documents(awkward, limits).collect()
    check(rows, limits)
    want = Counter()
    for r in awkward.collect():
        coded = ids(r["text"])
        for k in range(0, len(coded), 256):
            part = coded[k:k + 256]
            want[r["doc_id"], k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


@pytest.mark.parametrize("text", ["Hello WORLD don't we'll", "<|startoftext|>a<|endoftext|>", "İstanbul ΣΑΣ é é ½", "a\x1cb c\x85d", "x" * 3000, "1234 !!! ''s"])
def test_words_equal_the_library(text):
    coder = pk.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(coder.texts([text])[0], "<u4").tolist() == ids(text)[:-1]


def test_wrong_input(spark, nothing):
    assert pk.pack_documents(nothing).collect() == []
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 9000)], "doc_id long, length long"))
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 9, 1)], "doc_id long, length long, offset long"))
    with pytest.raises(ValueError):
        pk.Limits(0).piece()


def test_repeated_pieces_and_a_common_length(spark):
    limits = pk.Limits(10, 10, 100)
    rows = pk.pack(spark.createDataFrame([(1, 4)] * 50 + [(k, 3) for k in range(40)], "doc_id long, length long"), limits).collect()
    assert len(rows) == 90 and check(rows, limits) <= 39
