import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import alignment as al

TOKENIZERS = al.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" \n\x1c\x1f\x85\u2028\u200b's1²½", max_size=30), min_size=1, max_size=4))
def test_ids_equal_the_libraries(texts):
    a, b = TOKENIZERS.encode(texts)
    for text, own, other in zip(texts, a, b, strict=True):
        if not text or "▁" in text:
            assert own == other == []
            continue
        assert own == LIBRARY.encode(" " + text, add_special_tokens=False).ids
        assert other == TOKENIZERS.b.encode(text)


def brute(texts):
    """Facts per text, and documents per pair, token by token."""
    docs, count = [], Counter()
    for a, b in zip(*TOKENIZERS.encode(texts), strict=True):
        groups, one, other, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(TOKENIZERS.a_bytes[a[i]])
                one.append(a[i])
                i += 1
            else:
                at_b += len(TOKENIZERS.b_bytes[b[j]])
                other.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append((one, other))
                one, other = [], []
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    facts = []
    for n_a, n_b, groups, links in docs:
        joined = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        facts.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in links.items()), hashlib.sha256(joined.encode()).hexdigest() if joined else ""))
    return facts, count, top


def random_texts():
    rng = random.Random(3)
    words = ["the", "of", "Straße", "日本語", "tokenization", "😀", "3.14", "\n", "xqzj", "unbelievable"]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 300]))) for _ in range(40)]
    made += ["".join(rng.choice("ab c日😀\n") for _ in range(rng.choice([3, 50, 900]))) for _ in range(40)]
    return made + ["", None, " ", "a" * 3000, "a▁b", " " * 500, "<|endoftext|> <s> </s>", "日本😀語" * 300, "\x00", made[0], made[0]]


def check(spark, texts, parts=8, partitions=5):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    found = al.align(df, parts=parts)
    facts, count, top = brute(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.documents.collect()} == dict(enumerate(facts))
    assert {(r["a"], r["b"]): r["n"] for r in found.pairs.collect()} == dict(count)
    assert {tuple(r) for r in al.best_pairs(found).collect()} == {(x, y, n) for (x, y), n in count.items() if n == top[x]}


def test_random_texts(spark):
    check(spark, random_texts())


def test_many_blocks_slices_and_frames(spark, monkeypatch):
    # Smaller bounds in the driver's copy would not reach the workers, so the parts are tried one by one.
    monkeypatch.setattr(al, "TASK_BYTES", 500)
    check(spark, random_texts(), parts=3, partitions=9)


def test_one_word_in_all_texts(spark):
    check(spark, ["the same words " * (1 + k % 3) for k in range(400)] + ["the other"], parts=4, partitions=6)


def test_merge_of_runs_counts_every_pair(monkeypatch):
    monkeypatch.setattr(al, "FRAME", 7)
    rng = np.random.default_rng(4)
    runs, all_pairs = [], Counter()
    for _ in range(40):
        keys = np.unique(rng.integers(0, 60, rng.integers(0, 90)) << al.DOC_BITS | rng.integers(0, 50, 1))
        runs.append(al.frames(keys, np.ones(len(keys), np.int64)))
        all_pairs.update((keys >> al.DOC_BITS).tolist())
    got = [(int(p), int(n)) for pairs, counts in al.merged_counts(runs) for p, n in zip(pairs, counts)]
    assert got == sorted(all_pairs.items())
    back = [al.frame(runs[3], h)[0] for h in al.heads(runs[3])]
    assert (np.diff(np.concatenate(back)) > 0).all()


def test_large_groups_are_spread_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(al, "SPREAD", 50)
    rng = np.random.default_rng(5)
    group_a, group_b = np.sort(rng.integers(0, 6, 200)), np.sort(rng.integers(0, 6, 150))
    a, b, doc_of = rng.integers(0, 9, 200), rng.integers(0, 9, 150), np.array([0, 0, 1, 1, 2, 3])
    keys, counts = al.spread(group_a, a, group_b, b, doc_of)
    want = Counter((int(x), int(y), int(doc_of[g])) for g, x in zip(group_a, a) for h, y in zip(group_b, b) if g == h)
    low = (1 << al.ID_BITS) - 1
    assert {(int(k >> al.ID_BITS + al.DOC_BITS), int(k >> al.DOC_BITS) & low, int(k) & (al.BLOCK_DOCS - 1)): int(n) for k, n in zip(keys, counts)} == dict(want)


def test_blocks_fill_up(spark, monkeypatch):
    block = al.Block(0)
    assert not block.full()
    block.records = al.BLOCK_RECORDS
    assert block.full()
    texts = random_texts() * 110  # more documents than one block holds
    facts, _, _ = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert len(texts) > al.BLOCK_DOCS
    assert {r["doc_id"]: tuple(r)[1:] for r in al.align(df).documents.collect()} == dict(enumerate(facts))


def test_awkward_rows(awkward):
    rows = al.align(awkward).documents.collect()
    given = awkward.collect()
    facts, _, _ = brute([r["text"] for r in given])
    assert sorted((str(r["doc_id"]), *f) for r, f in zip(given, facts, strict=True)) == sorted((str(r[0]), *tuple(r)[1:]) for r in rows)


def test_empty_table(nothing):
    found = al.align(nothing)
    assert found.documents.collect() == [] and found.pairs.collect() == []
