import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import fingerprints as fp


def entropy(window):
    c = np.array(list(Counter(window).values()), float)
    return len(window) * np.log2(len(window)) - (c * np.log2(c)).sum()


@pytest.mark.parametrize("size", [1, 31, 32, 33, 200, 9000])
def test_window_entropies_equal_counting(size):
    data = np.random.default_rng(size).integers(97, 117, size).astype(np.uint8)
    got = fp.window_entropies(data, 32)
    assert len(got) == max(0, size - 31)
    assert all(abs(got[k] / 65536 - entropy(bytes(data[k:k + 32]))) < 1e-3 for k in range(0, len(got), 7))


def brute_votes(rank):
    votes = [0] * len(rank)
    for k in range(len(rank) - fp.RUN + 1):
        run = rank[k:k + fp.RUN]
        votes[k + int(np.argmin(run))] += 1
    return votes


def test_votes_equal_a_loop():
    rank = np.random.default_rng(3).integers(0, 50, 400)
    assert fp._votes(rank.astype(np.int64), np.zeros(400, np.int64)).tolist() == brute_votes(rank)
    halves = np.repeat([0, 1], 200)
    assert fp._votes(rank.astype(np.int64), halves).tolist() == brute_votes(rank[:200]) + brute_votes(rank[200:])


def text_of(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_a_digest_does_not_depend_on_its_batch():
    texts = [text_of(k, n) for k, n in enumerate((0, 1, 5, 30, 300, 4000))] + ["At " * 4000]
    together = fp.digests(texts)
    assert all(np.array_equal(fp.digests([t])[0], d) for t, d in zip(texts, together, strict=True))
    assert all(np.array_equal(fp.read(fp.written(d)), d) for d in together) and len(together[5]) > 3


def test_long_texts_are_read_to_the_end(monkeypatch):
    long = text_of(1, 200_000)
    a, b = fp.digests([long])[0], fp.digests([long[:-2000] + text_of(2, 400)])[0]
    assert not np.array_equal(a[-3:], b[-3:]) and fp.likeness(a, b) > 0.9


def test_likeness():
    a, b = fp.digests([text_of(1, 400), text_of(2, 400)])
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.2 and fp.likeness(a, b) == fp.likeness(b, a)
    near = fp.digests([text_of(1, 400) + " more words at the end"])[0]
    assert fp.likeness(a, near) > 0.8
    none = fp.digests([""])[0]
    assert fp.likeness(none, none) == 1 and fp.likeness(none, a) == 0


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in docs]
    digests = fp.digests(texts)
    want = []
    for k, (i, _) in enumerate(docs):
        after = texts[(k + 1) % len(texts)]
        cut = len(texts[k]) // 4
        edit = texts[k][:len(texts[k]) - cut] + after[:cut]
        changed = fp.digests([edit])[0]
        want.append((i, len(texts[k]), hashlib.sha256(edit.encode()).hexdigest(), fp.written(digests[k]), fp.written(changed),
                     fp.likeness(digests[k], changed), fp.likeness(digests[k], digests[(k + 1) % len(texts)])))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_neighbours_across_parts(spark, parts):
    docs = [(k * 3 % 101, text_of(k, k % 60) if k % 9 else None) for k in range(101)]
    check(fp.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), parts=parts).collect(), docs)


def test_awkward_rows(spark, awkward, nothing):
    check(fp.edited_fingerprints(awkward, parts=5).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert fp.edited_fingerprints(nothing).collect() == [] and fp.fingerprint(nothing).collect() == []
    one = spark.createDataFrame([(4, "a single text of some length")], "doc_id long, text string")
    row = fp.edited_fingerprints(one).collect()[0]
    assert row["near_next"] == 1 and fp.fingerprint(one).collect()[0]["fingerprint"] == row["fingerprint"]
