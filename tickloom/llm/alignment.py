"""Alignment of two tokenizers over a corpus by external spill counting.

Both tokenizers cut the same bytes.  Where a token of each ends at the same byte, a group ends, and the
tokens of a group are linked.  The count of a pair of ids is the number of documents that hold it linked.

Documents are read in blocks.  A block turns its distinct (A id, B id, document) records into sorted runs, one
per radix part of the A id, in zstandard frames (`spill`).  Tasks of one part, or of one slice of the blocks
where a part has many bytes, merge their runs with a heap and count each pair (`count_pairs`); Spark adds up
the slices.  The counts go back to the parts in A-major order, which gives the highest count of each A id,
and every run is streamed past them; a block gets back one sum per document and part (`contributions`), and
is put together from those (`documents_of`).
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import slices
from tickloom.llm.store import table
from tickloom.llm.token_counts import printable_bytes

#: Bits of an id and of a document's number within its block: a record is one 64-bit number.
ID_BITS, DOC_BITS = 20, 13
#: A block ends at so many documents, or once it holds so many records or bytes of text.
BLOCK_DOCS, BLOCK_RECORDS, BLOCK_BYTES = 1 << DOC_BITS, 1 << 20, 1 << 25
#: Records of one compressed frame, links that are spread out at a time, documents that are coded at a time.
FRAME, SPREAD, CODED = 4096, 1 << 21, 64
#: Radix parts, and bytes of runs that one task should take.
PARTS, TASK_BYTES = 64, 16 << 20
_HEAD = struct.Struct("<IIQ")


def byte_encoding(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level vocabulary file and the bytes of its ids, special tokens left out.

    It merges by the ids of the file, which is the same where ids follow the order of the merges; that is checked.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, of_char = spec["model"]["vocab"], printable_bytes()
    special = {t["content"] for t in spec["added_tokens"]}
    tokens = {bytes(of_char[c] for c in token): k for token, k in vocab.items() if token not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or len(merged) != len(set(merged)) or spec["normalizer"] is not None:
        raise ValueError("the ids of the vocabulary do not follow its merges")
    encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
    out = [b""] * (max(vocab.values()) + 1)
    for data, k in tokens.items():
        out[k] = data
    return encoding, out


class Tokenizers:
    """Ids of both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=b_path)
        self.a, self.a_bytes = byte_encoding(a_path)
        total = self.b.vocab_size()
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(self.b.id_to_piece(list(range(total))))
        ]
        if max(len(self.a_bytes), total) > 1 << ID_BITS:
            raise ValueError("a vocabulary has too many ids")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # An id in a group is followed by a comma, the last of A by a bar and the last of B by a semicolon.
        self.b_words = 2 * len(self.a_bytes)
        self.words = [f"{k}{end}" for k in range(len(self.a_bytes)) for end in ",|"] + [f"{k}{end}" for k in range(total) for end in ",;"]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B per text; both empty where a text has none or the bytes of either differ from it."""
        at = [k for k, t in enumerate(texts) if t]
        a, b = [[] for _ in texts], [[] for _ in texts]
        for k, other in zip(at, self.b.encode([texts[k] for k in at], num_threads=1), strict=True):
            data, ids = (" " + texts[k]).encode(), self.a.encode_ordinary(" " + texts[k])
            if b"".join(map(self.a_bytes.__getitem__, ids)) == data == b"".join(map(self.b_bytes.__getitem__, other)):
                a[k], b[k] = ids, other
        return a, b


@lru_cache(maxsize=2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def spread(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct records (A id, B id, document) of all links and how many links each stands for.

    Tokens are given with their group, `doc_of` has the document of a group.  Equal ids of a group are put
    together first, and links are spread out a bounded number at a time.
    """
    low = np.int64((1 << ID_BITS) - 1)
    left, n_left = np.unique((group_a << ID_BITS) | a, return_counts=True)
    right, n_right = np.unique((group_b << ID_BITS) | b, return_counts=True)
    first = np.searchsorted(right >> ID_BITS, left >> ID_BITS, "left")
    many = np.searchsorted(right >> ID_BITS, left >> ID_BITS, "right") - first
    upto = np.cumsum(many)
    keys, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SPREAD, "right")))
        sizes = many[at:end]
        rows = np.repeat(np.arange(at, end), sizes)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[rows]
        record = ((((left[rows] & low) << ID_BITS) | (right[other] & low)) << DOC_BITS) | doc_of[left[rows] >> ID_BITS]
        found = _added(record, n_left[rows] * n_right[other])
        keys.append(found[0]), counts.append(found[1])
        at = end
    return _added(np.concatenate(keys), np.concatenate(counts))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(counts, start)


def frames(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with their counts as frames, each behind its records, bytes and first key."""
    out, press = [], zstandard.ZstdCompressor(level=3)
    for at in range(0, len(keys), FRAME):
        part = keys[at:at + FRAME]
        body = press.compress(np.diff(part, prepend=part[:1]).astype("<i8").tobytes() + counts[at:at + FRAME].astype("<i8").tobytes())
        out.append(_HEAD.pack(len(part), len(body), int(part[0])) + body)
    return b"".join(out)


def heads(data: bytes) -> list[tuple[int, int, int, int]]:
    """(first key, place, bytes, records) of every frame."""
    found, at = [], 0
    while at < len(data):
        n, size, first = _HEAD.unpack_from(data, at)
        found.append((first, at + _HEAD.size, size, n))
        at += _HEAD.size + size
    return found


def frame(data: bytes, head: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    first, at, size, n = head
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:at + size]), "<i8")
    return np.cumsum(values[:n]) + first, values[n:]


def merged_counts(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, records of it) of all runs in the order of pairs: a k-way merge with a heap over the runs' next frames.

    Only a frame or so of each run is open at a time; a pair is given out once no run can hold more of it.
    """
    places = [heads(r) for r in runs]
    heap = [(p[0][0], k, 0) for k, p in enumerate(places) if p]
    heapify(heap)
    held, many = np.zeros(0, np.int64), max(16, len(runs) // 4)
    while heap:
        parts = [held]
        for _ in range(min(many, len(heap))):
            _, k, f = heappop(heap)
            parts.append(frame(runs[k], places[k][f])[0] >> DOC_BITS)
            if f + 1 < len(places[k]):
                heappush(heap, (places[k][f + 1][0], k, f + 1))
        held = np.sort(np.concatenate(parts), kind="stable")
        end = int(np.searchsorted(held, heap[0][0] >> DOC_BITS)) if heap else len(held)
        done, held = held[:end], held[end:]
        if len(done):
            start = np.flatnonzero(np.append(True, done[1:] != done[:-1]))
            yield done[start], np.diff(np.append(start, len(done)))


class Block:
    """Documents that are coded but not yet given out, and their records."""

    def __init__(self, number: int):
        self.number, self.bytes, self.records = number, 0, 0
        self.ids, self.facts = [], []
        self.keys, self.counts = [], []

    def full(self) -> bool:
        return len(self.facts) + CODED > BLOCK_DOCS or self.records >= BLOCK_RECORDS or self.bytes >= BLOCK_BYTES

    def add(self, tokenizers: Tokenizers, ids: pa.Array, texts: list[str | None]) -> None:
        a, b = tokenizers.encode(texts)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        a_ids = np.array([k for x in a for k in x], np.int64)
        b_ids = np.array([k for x in b for k in x], np.int64)
        # The bytes of a document are the same in both, so ends count on from one document to the next.
        a_end, b_end = np.cumsum(tokenizers.a_sizes[a_ids]), np.cumsum(tokenizers.b_sizes[b_ids])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc_of = np.zeros(len(ends), np.int64)
        doc_of[group_a] = doc_a
        links = np.bincount(group_a, minlength=len(ends)) * np.bincount(group_b, minlength=len(ends))
        n_groups = np.bincount(doc_of, minlength=len(texts)) if len(ends) else np.zeros(len(texts), np.int64)
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc_of, links)
        keys, counts = spread(group_a, a_ids, group_b, b_ids, doc_of + len(self.facts))
        self.keys.append(keys), self.counts.append(counts)
        self.records += len(keys)
        self.bytes += sum(len(t) for t in texts if t)
        digests = self._digests(tokenizers, group_a, a_ids, group_b, b_ids, n_a + n_b)
        self.ids.append(ids)
        self.facts.extend(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, strict=True))

    @staticmethod
    def _digests(tokenizers: Tokenizers, group_a, a_ids, group_b, b_ids, sizes: np.ndarray) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` per document."""
        last = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in (group_a, group_b)]
        words = np.concatenate([2 * a_ids + last[0], tokenizers.b_words + 2 * b_ids + last[1]])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words, out, at = words[order].tolist(), [], 0
        for size in sizes.tolist():
            joined = "".join(map(tokenizers.words.__getitem__, words[at:at + size]))
            out.append(hashlib.sha256(joined[:-1].encode()).hexdigest() if joined else "")
            at += size
        return out

    def rows(self, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(block, part, records, data): the documents as part -1, then the runs."""
        ids = pa.chunked_array(self.ids).combine_chunks() if len(self.ids) > 1 else self.ids[0]
        columns = [ids, *(pa.array([f[k] for f in self.facts], kind) for k, kind in enumerate((*[pa.int64()] * 4, pa.string())))]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield self.number, -1, len(self.facts), sink.getvalue().to_pybytes()
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        part = (keys >> (ID_BITS + DOC_BITS)) % parts
        order = np.lexsort((keys, part))
        keys, counts, part = keys[order], counts[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            low, high = int(cuts[p]), int(cuts[p + 1])
            if high > low:
                yield self.number, p, high - low, frames(keys[low:high], counts[low:high])


_SPILLED = "block long, part int, records long, data binary"


def _spill_batch(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["block", "part", "records", "data"])


def spill(df: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str, parts: int) -> DataFrame:
    """(block, part, records, data): per block its documents (part -1) and its runs."""
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(public_tokenizers.path(a_file), public_tokenizers.path(b_file))
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for whole in batches:
            for batch in slices(whole, 1, rows=CODED):
                # Copied, so that a block does not hold on to the texts beside its ids.
                block.add(tokenizers, batch.column(0).take(pa.array(range(len(batch)), pa.int64())), batch.column(1).to_pylist())
                if block.full():
                    yield from (_spill_batch([row]) for row in block.rows(parts))
                    number += 1
                    block = Block(number)
        if block.facts:
            yield from (_spill_batch([row]) for row in block.rows(parts))

    return source.mapInArrow(run, _SPILLED)


def _dealt(runs: DataFrame, slices: dict[int, int]) -> DataFrame:
    """Runs with the slice of their part, in one task per part and slice as a rule."""
    of_part = F.create_map(*[F.lit(v) for item in slices.items() for v in item])
    return runs.withColumn("slice", F.pmod(F.xxhash64("block"), of_part[F.col("part")]))


def count_pairs(runs: DataFrame, tasks: int) -> DataFrame:
    """(part, a, b, n): in how many documents each pair is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(p, d) for batch in batches for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for part in sorted({p for p, _ in data}):
            for pairs, n in merged_counts([d for p, d in data if p == part]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), part, np.int32)), pa.array((pairs >> ID_BITS).astype(np.int32)),
                     pa.array((pairs & ((1 << ID_BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["part", "a", "b", "n"])

    partial = runs.repartition(tasks, "part", "slice").select("part", "data").mapInArrow(run, "part int, a int, b int, n long")
    return partial.groupBy("part", "a", "b").agg(F.sum("n").alias("n"))


def _packed_counts(pairs: DataFrame, parts: int) -> DataFrame:
    """The counts of each part as frames in A-major order: (part, data)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, a, b, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            rows = [(int(part[s]), frames((a[s:e] << ID_BITS) | b[s:e], n[s:e])) for s, e in zip(edges[:-1], edges[1:]) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])

    ordered = pairs.repartition(parts, "part").sortWithinPartitions("part", "a", "b").select("part", "a", "b", "n")
    return ordered.mapInArrow(run, "part int, data binary")


def contributions(runs: DataFrame, counts: DataFrame, slices: dict[int, int], tasks: int) -> DataFrame:
    """(block, part, records, data): per run and document the links of highest count and the sum of counts."""
    last = F.create_map(*[F.lit(v) for item in slices.items() for v in item])[F.col("part")] - 1
    sent = counts.select(F.lit(-1).cast("long").alias("block"), "part", "data", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("slice"))
    both = runs.select("block", "part", "data", F.col("slice").cast("long").alias("slice")).unionByName(sent)
    # The counts come before the runs, a part after the other, so that one part's counts are open at a time.
    ordered = both.repartition(tasks, "part", "slice").sortWithinPartitions("part", "block").select("block", "part", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pairs = n = best = None
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for block, own, data in zip(*(batch.column(k) for k in range(3))):
                block, own, data = block.as_py(), own.as_py(), data.as_py()
                if own != part:
                    part, pairs, gathered = own, None, []
                if block < 0:
                    gathered.extend(frame(data, head) for head in heads(data))
                    continue
                if pairs is None:
                    # Two slices of a part in one task bring its counts twice.
                    pairs, first = np.unique(np.concatenate([k for k, _ in gathered]), return_index=True)
                    n = np.concatenate([c for _, c in gathered])[first]
                    start = np.flatnonzero(np.append(True, (pairs[1:] >> ID_BITS) != (pairs[:-1] >> ID_BITS)))
                    best = n == np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(n))))
                    gathered = []
                sums = np.zeros((2, BLOCK_DOCS), np.int64)
                for head in heads(data):
                    keys, links = frame(data, head)
                    place, docs = np.searchsorted(pairs, keys >> DOC_BITS), keys & (BLOCK_DOCS - 1)
                    np.add.at(sums[0], docs, links * best[place])
                    np.add.at(sums[1], docs, links * n[place])
                used = np.flatnonzero(sums[1])
                packed = zstandard.ZstdCompressor(level=3).compress(np.stack([used, *sums[:, used]]).astype("<i8").tobytes())
                yield _spill_batch([(block, part, len(used), packed)])

    return ordered.mapInArrow(run, _SPILLED)


def documents_of(blocks: DataFrame, given: DataFrame, id_kind: str) -> DataFrame:
    """One row per document from its block and what the parts gave back."""
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = sums = None

        def done() -> pa.RecordBatch:
            found = [pa.array(s[:len(facts)], pa.int64()) for s in sums]
            return pa.RecordBatch.from_arrays([*facts.columns[:5], *found, facts.column(5)], columns)

        for batch in batches:
            for part, data in zip(batch.column(1), batch.column(2)):
                if part.as_py() < 0:
                    if facts is not None:
                        yield done()
                    facts, sums = pa.ipc.open_stream(data.as_py()).read_next_batch(), np.zeros((2, BLOCK_DOCS), np.int64)
                else:
                    used, best, total = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), "<i8").reshape(3, -1)
                    sums[0, used] += best
                    sums[1, used] += total
        if facts is not None:
            yield done()

    both = blocks.select("block", "part", "data").unionByName(given.select("block", "part", "data"))
    ordered = both.repartition("block").sortWithinPartitions("block", "part")
    kinds = ["long"] * 6
    schema = f"doc_id {id_kind}, " + ", ".join(f"{c} {k}" for c, k in zip(columns[1:7], kinds)) + ", groups_sha256 string"
    return ordered.mapInArrow(run, schema)


@dataclass
class Alignment:
    documents: DataFrame  # doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    pairs: DataFrame      # a, b, n: documents that hold the pair linked


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model",
    parts: int = PARTS,
) -> Alignment:
    """Aligns the tokens of a byte-level vocabulary A (of space and text) with those of a piece vocabulary B.

    A null or empty text, and one whose bytes a tokenizer does not give back, has no tokens: zeros and an
    empty digest.  Null ids stay null, repeated rows are documents of their own, other columns are left out,
    so no name can clash.  Of several pairs with the highest count of their A id each is best.  A text of any
    length is one row's work; its links are spread out a bounded number at a time.  An empty table gives empty
    tables.
    """
    spilled = table(spill(df, id_col, text_col, a_file, b_file, parts), "spilled")
    kind = df.select(df[id_col].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    runs, blocks = spilled.filter("part >= 0"), spilled.filter("part < 0")
    sizes = {r[0]: r[1] for r in runs.groupBy("part").agg(F.sum(F.octet_length("data"))).collect()}  # at most `parts` rows
    slices = {p: max(1, -(-s // TASK_BYTES)) for p, s in sizes.items()} or {0: 1}
    tasks = sum(slices.values())
    dealt = _dealt(runs, slices)
    pairs = table(count_pairs(dealt, tasks), "pair-counts")
    given = contributions(dealt, table(_packed_counts(pairs, parts), "packed-counts"), slices, tasks)
    return Alignment(documents_of(blocks, given, kind), pairs.select("a", "b", "n"))


def best_pairs(alignment: Alignment) -> DataFrame:
    """For each A id the B ids it is linked with in most documents, ties included: (a, b, n)."""
    most = alignment.pairs.groupBy("a").agg(F.max("n").alias("n"))
    return alignment.pairs.join(most, ["a", "n"]).select("a", "b", "n")
