"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts lie one after another in one numpy array of symbols.  In every round each
pre-token finds the lowest rank among its neighbouring pairs and merges all pairs of that rank at once;
a pre-token without a known pair is finished, and its surviving symbols are its tokens.  A pair that a
merge makes has a higher rank than the merge itself, so rounds give what merging one pair at a time gives.
A pre-token of very many symbols has its places in buckets by rank, and its rounds cost what they touch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.batches import give_back, slices
from tickloom.llm.merging import SHIFT, group_places, merge_sequence
from tickloom.llm.pretokens import byte_level

#: Bytes of unknown pre-tokens that are merged together, and bytes of one from which it is merged by itself.
BATCH_BYTES, LONG = 1 << 18, 512
#: Pre-tokens and their characters that a worker remembers at most, and the longest of them.
REMEMBERED, REMEMBERED_CHARS, SHORT = 200_000, 3_000_000, 64
_NONE = np.int64(1 << 40)
_SHIFT = np.int64(SHIFT)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file (a public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class RankMerger:
    """Counts the tokens of pre-tokens under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.first = np.zeros(256, np.int64)
        for char, byte in printable_bytes().items():
            self.first[byte] = vocab[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << int(_SHIFT)) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int64), _NONE)
        self.merged = np.append(np.array([vocab[a + b] for a, b in merges], np.int64)[order], 0)
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.known: dict[str, int] = {}
        self.held = 0

    def _count_long(self, pretoken: bytes) -> int:
        if self.pairs is None:
            self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys[:-1], self.ranks, self.merged)}
        symbols = self.first[np.frombuffer(pretoken, np.uint8)]
        keys = (symbols[:-1] << _SHIFT) | symbols[1:]
        at = np.searchsorted(self.keys, keys)
        ranks = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        return len(merge_sequence(symbols.tolist(), group_places(ranks, int(_NONE)), self.pairs))

    def count_all(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of every (non-empty) pre-token."""
        counts = np.zeros(len(pretokens), np.int64)
        sizes = np.array([len(p) for p in pretokens], np.int64)
        symbols = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        ids = np.arange(len(pretokens))
        while len(ids):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            keys = np.full(len(symbols), -1, np.int64)
            keys[:-1] = (symbols[:-1] << _SHIFT) | symbols[1:]
            keys[ends - 1] = -1
            at = np.searchsorted(self.keys, keys)
            ranks = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < _NONE
            if not going.all():
                counts[ids[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                symbols, ranks, at = symbols[keep], ranks[keep], at[keep]
                ids, sizes, lowest = ids[going], sizes[going], lowest[going]
                if not len(ids):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            hit = self._apart(hit)
            symbols = np.where(hit, self.merged[at], symbols)
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~hit[:-1]
            symbols = symbols[keep]
            sizes = sizes - np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        return counts

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of hits in a row (as in "aaa") every other one, from the first."""
        if not (hit[1:] & hit[:-1]).any():
            return hit
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        run_start = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = np.zeros_like(hit)
        out[at[(at - run_start) % 2 == 0]] = True
        return out

    def learned(self, pretokens: set[str]) -> dict[str, int]:
        """Tokens of each of the pre-tokens."""
        found: dict[str, int] = {}
        batch, size = [], 0
        for p in pretokens:
            data = p.encode()
            if len(data) > LONG:
                found[p] = self._count_long(data)
                continue
            batch.append((p, data))
            size += len(data)
            if size > BATCH_BYTES:
                found.update(self._counted(batch))
                batch, size = [], 0
        found.update(self._counted(batch))
        return found

    def _counted(self, batch: list[tuple[str, bytes]]) -> dict[str, int]:
        if not batch:
            return {}
        return dict(zip([p for p, _ in batch], self.count_all([d for _, d in batch]).tolist(), strict=True))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; strings of special tokens count as one token, as in the library's default."""
        totals, found = [], []
        for text in texts:
            parts, special = [text], 0
            for token in self.special:
                if token in text:
                    parts = [q for p in parts for q in p.split(token)]
                    special += text.count(token)
            totals.append(special)
            found.append([p for part in parts for p in byte_level(part)])
        new = self.learned({p for pretokens in found for p in pretokens if p not in self.known})
        known = self.known
        counts = [n + sum([known[p] if p in known else new[p] for p in pretokens]) for n, pretokens in zip(totals, found, strict=True)]
        self._remember({p: n for p, n in new.items() if len(p) <= SHORT})
        return counts

    def _remember(self, new: dict[str, int]) -> None:
        size = sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED or self.held + size > REMEMBERED_CHARS:
            self.known, self.held = {}, 0
        if len(new) <= REMEMBERED and size <= REMEMBERED_CHARS:
            self.known.update(new)
            self.held += size


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512,
) -> DataFrame:
    """Bytes and tokens of every whole text; the vocabulary is a file name known to `public_tokenizers`.

    A null text is an empty text: 0 bytes, 0 tokens.  A null id stays null and repeated rows are counted
    each.  Any other column is left out, so no name can clash.  An empty table gives an empty table.  A text of
    any length is one row's work, at a cost in proportion to its length, unbroken runs of letters included.
    """
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(public_tokenizers.path(vocabulary))
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = counter.count_texts(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter.known, counter.held = {}, 0
        give_back()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
