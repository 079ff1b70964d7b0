"""SentencePiece encoding and decoding by vectorised merge rounds.

A text gets its leading space, spaces become U+2581, and it is cut into words before every U+2581 that
follows another character; no piece of the vocabulary reaches over such a place.  The characters of many
new words lie one after another in one numpy array of symbols.  In every round each word finds the lowest
rank among its neighbouring pairs and merges all places of that rank at once, from left to right, up to
the first one whose merge makes a pair that has to go before the next place.  Words without a known pair
are taken out.  Characters that the vocabulary lacks become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.batches import slices
from tickloom.llm.merging import SHIFT, group_places, merge_sequence

SPACE = "▁"
#: Characters of words that are merged together; longer words go by themselves.
BATCH_CHARS, LONG = 1 << 16, 512
#: Bytes and rows of texts that are coded together.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 1024
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.int64(1 << 40)
#: A character that the vocabulary lacks is the symbol _UNKNOWN - its number.
_UNKNOWN = -2

codecs.register_error("tickloom-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PairTable:
    """Ranks and merged symbols of known pairs, looked up for whole arrays in two hash tables without chains."""

    BITS = 19

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        keys = np.array(sorted(pairs), np.uint64)
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        self.ranks = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int64), _NONE)
        self.merged = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int64), 0)
        if len(keys) > 1 << (self.BITS - 2):
            raise ValueError("the vocabulary has too many pairs")
        missing = len(keys)
        self.factors, self.tables, left = [], [], np.arange(len(keys))
        for factor in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 20_000, 2):
            place = self._place(keys[left], factor)
            _, first = np.unique(place, return_index=True)
            if self.tables and len(first) < len(left):
                continue  # the second table has to take all that the first one could not
            table = np.full(1 << self.BITS, missing, np.int32)
            table[place[first]] = left[first]
            self.factors.append(np.uint64(factor)), self.tables.append(table)
            left = np.delete(left, first)
            if not len(left):
                break
        if len(left):
            raise ValueError("no hash places all pairs")

    def _place(self, keys: np.ndarray, factor: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(SHIFT))) * np.uint64(factor)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.BITS)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in `ranks` and `merged`; the last one where there is no such pair."""
        keys = ((left << SHIFT) | right).view(np.uint64)  # a negative symbol gives a key that no table holds
        at = self.tables[0][self._place(keys, self.factors[0])]
        if len(self.tables) > 1:
            other = self.tables[1][self._place(keys, self.factors[1])]
            at = np.where(self.keys[at] == keys, at, other)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)


class PieceModel:
    """The merge rules of one SentencePiece file of kind BPE with byte fallback, which leaves texts as they are."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        if library.normalize(" ﬁ  x ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("only vocabularies that leave a text as it is, behind one space, can be read")
        total = library.vocab_size()
        self.pieces = [library.id_to_piece(k) for k in range(total)]
        self.of_byte = np.full(256, -1, np.int64)
        self.written: list[bytes] = []  # the bytes that a piece stands for
        normal: dict[str, int] = {}
        for k, piece in enumerate(self.pieces):
            if library.is_byte(k):
                self.of_byte[int(piece[1:-1], 16)] = k
                self.written.append(bytes([int(piece[1:-1], 16)]))
            elif library.is_unknown(k):
                self.written.append(" ⁇ ".encode())
            elif library.is_control(k):
                self.written.append(b"")
            else:
                normal[piece] = k
                self.written.append(piece.replace(SPACE, " ").encode())
        if (self.of_byte < 0).any() or {c for p in normal for c in p} - set(normal):
            raise ValueError("the vocabulary needs a piece for every byte and for every character of a piece")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece of the vocabulary goes over the start of a word")
        scores = {k: library.get_score(k) for k in normal.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores, equal rank
        self.pairs: dict[int, tuple[int, int]] = {}
        for piece, k in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = (rank_of[scores[k]], k)
        self.table = PairTable(self.pairs)
        self.names = [str(k) for k in range(total)]
        self.first = _UNKNOWN - np.arange(0x110000, dtype=np.int64)
        for piece, k in normal.items():
            if len(piece) == 1:
                self.first[ord(piece)] = k

    def symbols(self, text: str) -> np.ndarray:
        return self.first[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes): the symbols of each (non-empty) word when no known pair is left, one after another."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat, ids = self.symbols("".join(words)), np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(ids):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            right = np.append(flat[1:], -1)
            right[ends - 1] = -1
            at = self.table.find(flat, right)
            ranks = self.table.ranks[at]
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < _NONE
            if not going.all():
                keep = np.repeat(going, sizes)
                done.append((ids[~going], sizes[~going], flat[~keep]))
                flat, ranks, at, ids, sizes, lowest = flat[keep], ranks[keep], at[keep], ids[going], sizes[going], lowest[going]
                if not len(ids):
                    break
            word = np.repeat(np.arange(len(ids)), sizes)
            hits = self._in_order(flat, at, word, np.flatnonzero(ranks == lowest[word]), lowest)
            flat[hits] = self.table.merged[at[hits]]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            flat = flat[keep]
            sizes = sizes - np.bincount(word[hits], minlength=len(sizes))
        ids, sizes, flat = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(ids)
        return gather(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def _in_order(self, flat: np.ndarray, at: np.ndarray, word: np.ndarray, hits: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """The places of `hits` that merging one after another from the left takes before any other pair's turn."""
        # Of places in a row, as in "aaa", every other one.
        fresh = np.ones(len(hits), bool)
        fresh[1:] = np.diff(hits) > 1
        run = hits[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        hits = hits[(hits - run) % 2 == 0]
        made, own, n = self.table.merged[at[hits]], word[hits], len(flat)
        behind = np.minimum(hits + 2, n - 1)
        follower = np.where((hits + 2 < n) & (word[behind] == own), flat[behind], -1)
        ahead = np.maximum(hits - 1, 0)
        leader = np.where((hits > 0) & (word[ahead] == own), flat[ahead], -1)
        touching = np.zeros(len(hits), bool)
        touching[1:] = (np.diff(hits) == 2) & (own[1:] == own[:-1])
        leader[1:] = np.where(touching[1:], made[:-1], leader[1:])
        ranks = self.table.ranks
        turn = np.minimum(ranks[self.table.find(made, follower)], ranks[self.table.find(leader, made)]) <= lowest[own]
        done = np.cumsum(turn) - turn
        first = np.searchsorted(own, own)  # the first hit of the same word
        return hits[done == done[first]]

    def _long(self, word: str) -> np.ndarray:
        flat = self.symbols(word)
        ranks = self.table.ranks[self.table.find(flat, np.append(flat[1:], -1))]
        return np.array(merge_sequence(flat.tolist(), group_places(ranks, int(_NONE)), self.pairs), np.int64)

    def _with_bytes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that the vocabulary lacks as the pieces of their bytes."""
        unknown = np.flatnonzero(flat < 0)
        if not len(unknown):
            return flat, sizes
        coded = [self.of_byte[list(chr(_UNKNOWN - s).encode())] for s in flat[unknown].tolist()]
        many = np.ones(len(flat), np.int64)
        many[unknown] = [len(c) for c in coded]
        out = np.repeat(flat, many)
        out[np.repeat(flat < 0, many)] = np.concatenate(coded)
        word = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(word, many, len(sizes)).astype(np.int64)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of any length, in order."""
        parts, batch, size = [], [], 0

        def close() -> None:
            nonlocal batch, size
            if batch:
                parts.append(self.merge_words(batch))
            batch, size = [], 0

        for w in words:
            if len(w) > LONG:
                close()
                symbols = self._long(w)
                parts.append((symbols, np.array([len(symbols)])))
                continue
            batch.append(w)
            size += len(w)
            if size > BATCH_CHARS:
                close()
        close()
        return self._with_bytes(*(np.concatenate(c) for c in zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def coded(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(tokens, ids as comma-joined text, decoded UTF-8) of whole texts, in order; equal words are merged once."""
        place: dict[str, int] = {}
        counts, at = [], []
        for text in texts:
            found = _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []
            counts.append(len(found))
            at.extend([place.setdefault(w, len(place)) for w in found])
        flat, sizes = self._merged(list(place))
        at = np.array(at, np.int64)
        tokens = gather(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
        ends = np.append(0, np.cumsum(sizes[at]))[np.cumsum(counts, dtype=np.int64)] if len(texts) else []
        names, written, start = self.names, self.written, 0
        for end in ends:
            ids = tokens[start:end].tolist()
            yield len(ids), ",".join([names[k] for k in ids]).encode(), b"".join([written[k] for k in ids])[1:]
            start = end

    def encode(self, text: str) -> list[int]:
        (_, joined, _), = self.coded([text])
        return [int(k) for k in joined.split(b",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: the space before the first piece goes, a byte outside UTF-8 becomes U+FFFD."""
        joined = b"".join(map(self.written.__getitem__, ids))
        return joined.removeprefix(b" ").decode("utf-8", "tickloom-each-byte")


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size] one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", keep: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text, without begin and end ids.

    `ids_sha256` is taken of the decimal ids joined by commas, `decoded_sha256` of the text that decoding
    the ids gives, in UTF-8.  A null or empty text has no tokens and decodes to the empty text.  A null id
    stays null, repeated rows are coded each, other columns are left out, so no name can clash.  An empty
    table gives an empty table.  A text of any length is one row's work: its words are coded one by one,
    and a word of very many characters by its places, at a cost in proportion to its length.  Pairs of
    equal score (ties) merge from the left.
    """
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(public_tokenizers.path(vocabulary))
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES, SLICE_ROWS):
                counts, ids, decoded, kept, texts = [], [], [], [], []
                for n, joined, written in model.coded([t or "" for t in batch.column(1).to_pylist()]):
                    counts.append(n)
                    ids.append(hashlib.sha256(joined).hexdigest())
                    decoded.append(hashlib.sha256(written).hexdigest())
                    if keep:
                        kept.append([int(k) for k in joined.split(b",")] if joined else [])
                        texts.append(written.decode("utf-8", "tickloom-each-byte"))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if keep:
                    columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return source.mapInArrow(run, schema)
