"""Improbable-feature digests.

Every window of bytes of a text is ranked by how improbable its entropy is; within every run of windows
the most improbable one gets a vote, and windows with enough votes are the text's features.  Features go,
in text order, into a chain of Bloom filters of fixed size; two digests are compared filter by filter, by
the bits they share beyond those that two random filters of their fill would share.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.words import PIECE_BYTES, groups_of_texts, mix, span_hashes

#: Bytes of a window, windows of a run, votes of a feature.
WINDOW, RUN, VOTES = 32, 32, 8
#: Texts with fewer features than this also have filters of all their runs of SHORT bytes.
FEW, SHORT = 24, 4
#: Bits of a filter, features that it takes, and bits that a feature sets (11 bits of its hash each).
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Entropy in bits of a window of running text, of which others are the more improbable the further off.
USUAL_BITS = 3.4
_LANES, _SCALE = 4096, 1 << 16


def _log_steps(window: int) -> np.ndarray:
    """(c + 1) log2(c + 1) - c log2(c), scaled to whole numbers, for counts c of a byte in a window."""
    c = np.arange(window + 2, dtype=float)
    terms = np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0) * _SCALE).astype(np.int64)
    return np.diff(terms)


def window_entropies(data: np.ndarray, window: int) -> np.ndarray:
    """Scaled entropy (bits * window * 65536, whole numbers) of every window of the bytes.

    The bytes are cut into lanes that overlap by a window, and all lanes slide at once: one byte enters,
    one leaves, and the sum over bytes of count * log2(count) follows.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = max(64, -(-n // _LANES))
    lanes = -(-n // step)
    padded = np.zeros(lanes * step + window, np.uint8)
    padded[:len(data)] = data[:len(padded)]
    base = np.arange(lanes) * step
    cells = np.arange(lanes, dtype=np.int64) * 256
    counts = np.zeros(lanes * 256, np.uint8)
    gain = _log_steps(window)
    total = np.zeros(lanes, np.int64)
    out = np.empty((step, lanes), np.int64)
    columns = np.lib.stride_tricks.sliding_window_view(padded, step + window - 1)[base].T.astype(np.int64)
    for t in range(step + window - 1):
        cell = cells + columns[t]
        now = counts[cell]
        total += gain[now]
        counts[cell] = now + 1
        if t >= window - 1:
            out[t - window + 1] = total
            cell = cells + columns[t - window + 1]
            now = counts[cell] - 1
            total -= gain[now]
            counts[cell] = now
    whole = int(round(window * np.log2(window) * _SCALE))
    return (whole - out.T.reshape(-1)[:n])


def _improbability(entropy: np.ndarray, window: int) -> np.ndarray:
    """Whole numbers, smaller for less usual entropies; windows of next to no entropy say nothing and come last."""
    usual = int(USUAL_BITS * window * _SCALE)
    rank = (1 << 30) - np.abs(entropy - usual)
    return np.where(entropy < window * _SCALE, np.int64(1 << 31), rank)


def _votes(rank: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Votes of every window: in each run of RUN windows of one text the first of the lowest rank gets one."""
    n = len(rank)
    key = (rank << np.int64(24)) | np.arange(n, dtype=np.int64)
    width = 1
    while width < RUN:
        by = min(width, RUN - width)
        key = np.minimum(key[:-by], key[by:]) if len(key) > by else key[:0]
        width += by
    if not len(key):
        return np.zeros(n, np.int64)
    inside = edges[:len(key)] == edges[RUN - 1:]
    return np.bincount((key & np.int64((1 << 24) - 1))[inside], minlength=n)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the features of each text, and of its short runs if those are few; in text order, without repeats."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for first, last in groups_of_texts(offsets, PIECE_BYTES // 2):
        joined = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        lengths = np.diff(offsets[first:last + 1])
        # A long text is cut into pieces that overlap by a run of windows.
        for at in range(0, max(1, len(joined)), PIECE_BYTES // 2):
            piece = joined[max(0, at - (WINDOW + RUN)):at + PIECE_BYTES // 2]
            shift = max(0, at - (WINDOW + RUN))
            _piece_features(piece, shift, np.cumsum(lengths) - lengths, lengths, out, first)
    found = []
    for own, text in zip(out, texts, strict=True):
        chosen = _once(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        found.append((chosen, _short_features(text) if len(chosen) < FEW else chosen[:0]))
    return found


def _short_features(text: bytes) -> np.ndarray:
    """Every run of SHORT bytes, or the whole of a shorter text, for texts that are short or too even for windows."""
    data, size, found = np.frombuffer(text, np.uint8), min(SHORT, len(text)), [np.zeros(0, np.uint64)]
    for at in range(0, len(data) - size + 1 if size else 0, PIECE_BYTES // 2):
        piece = data[at:at + PIECE_BYTES // 2 + size - 1]
        starts = np.arange(len(piece) - size + 1)
        found.append(_once(span_hashes(piece, starts, starts + size)))
    return _once(np.concatenate(found))


def _piece_features(data: np.ndarray, shift: int, starts: np.ndarray, lengths: np.ndarray, out: list[list[np.ndarray]], first: int) -> None:
    entropy = window_entropies(data, WINDOW)
    place = np.arange(len(entropy)) + shift
    text = np.searchsorted(starts + lengths, place, "right")
    whole = (place + WINDOW <= (starts + lengths)[np.minimum(text, len(starts) - 1)]) & (text < len(starts))
    owner = np.where(whole, text, -1 - np.arange(len(entropy)))
    rank = np.where(whole, _improbability(entropy, WINDOW), np.int64(1 << 31))
    votes = _votes(rank, owner) if len(rank) else rank
    chosen = np.flatnonzero((votes >= VOTES) & whole)
    hashes = span_hashes(data, chosen, chosen + WINDOW) if len(chosen) else np.zeros(0, np.uint64)
    owners = text[chosen]
    for k in np.unique(owners):
        out[first + k].append(hashes[owners == k] if len(starts) < 4 else hashes[np.searchsorted(owners, k):np.searchsorted(owners, k, "right")])


def _once(hashes: np.ndarray) -> np.ndarray:
    _, at = np.unique(hashes, return_index=True)
    return hashes[np.sort(at)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of FILTER_BITS / 8 bytes each."""
    count = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BITS), np.uint8)
    spread = mix(hashes + np.uint64(1))
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(FEATURE_BITS):
        bits[row, ((spread >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap in the other.

    The overlap of two filters counts the shared bits beyond those expected by chance, as a share of the
    most that they could share beyond it.  Two empty digests are alike, an empty one is like no other.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    set_a, set_b = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    best = []
    for row, n in zip(a, set_a, strict=True):
        shared = np.bitwise_count(row[None, :] & b).sum(axis=1)
        chance = n * set_b / FILTER_BITS
        most = np.minimum(n, set_b)
        best.append(max(0.0, float(((shared - chance) / np.maximum(most - chance, 1e-9)).max())))
    return float(min(1.0, np.mean(best)))


def written(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    count, _, data = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(count), FILTER_BITS // 8)


def digests(texts: list[str]) -> list[np.ndarray]:
    return [np.concatenate([filters(long), filters(short)]) for long, short in features([t.encode() for t in texts])]


#: Bytes of text that a part of the rows in order of id should hold.
PART_BYTES = 12 << 20


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; a null text is empty and has the empty digest `0:`."""
    source = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(d) for d in digests(texts)])],
                    ["doc_id", "n_chars", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, tail, id, text) where each part holds a range of ids and, as its tail, the first row after it.

    Rows are dealt out by ranges of ids whose bounds come from a sketch of the ids, so no task sorts them
    all.  The last part's tail is the first row of all.  Null ids come first.
    """
    ids = df.select(df[id_col].cast("double").alias("at"))
    cuts = ids.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    bounds = [-float("inf"), *sorted(set(cuts or [0.0])), float("inf")]
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(-1.7976931348623157e308)))
    dealt = Bucketizer(splits=bounds, inputCol="at", outputCol="part").transform(rows).select(F.col("part").cast("int").alias("part"), "id", "text")
    # The smallest (id, text hash) of each part: one row per part, at most `parts`.
    order = F.struct(F.col("id"), F.md5("text").alias("hash"))
    heads = dealt.groupBy("part").agg(F.min(order).alias("head")).select("part", "head.id", "head.hash").collect()
    firsts = sorted((r["part"], r["id"], r["hash"]) for r in heads)
    if not firsts:
        return dealt.select("part", F.lit(0).alias("tail"), "id", "text")
    before = [(firsts[k - 1][0], *firsts[k][1:]) for k in range(len(firsts))]
    kind = rows.schema["id"].dataType.simpleString()
    wanted = F.broadcast(df.sparkSession.createDataFrame(before, f"__part int, __id {kind}, __hash string"))
    tails = dealt.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.md5("text") == F.col("__hash"))).select(
        F.col("__part").alias("part"), F.lit(1).alias("tail"), "id", "text").dropDuplicates(["part"])
    return dealt.select("part", F.lit(0).alias("tail"), "id", "text").unionByName(tails)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every text's digest beside that of its edited text, and how near they and the next text's are.

    The edit replaces the last quarter (rounded down) of the code points by the first as many of the next
    text, or all of it.  The next text is that of the next row by id, then by text; after the last row comes the
    first; a single row is its own next.  Repeated rows follow each other.  A null text is empty; other
    columns play no part; an empty table gives an empty table.  Rows are dealt into parts of about PART_BYTES of
    text; rows of one id (or without an id) lie in one part.  A text of any length is read whole.
    """
    if parts is None:
        size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")).cast("long") + 16)).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = with_next(df, id_col, text_col, parts)
    kind = rows.schema["id"].dataType.simpleString()
    order = Window.partitionBy("part").orderBy("tail", F.col("id").asc_nulls_first(), F.md5("text"))
    # One row back, so the next text comes with its own row and every text is digested once.
    paired = rows.withColumn("__last", F.lag("text").over(order)).withColumn("__last_id", F.lag("id").over(order)).withColumn("__has", F.lag(F.lit(True)).over(order))
    paired = paired.select("__last_id", "__has", "__last", "text", "part", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: tuple[str, np.ndarray] | None = None
        for whole in batches:
            for k in range(0, len(whole), 128):
                batch = whole.slice(k, 128)
                ids, has, lasts, texts = (batch.column(c).to_pylist() for c in range(4))
                live = [i for i in range(len(texts)) if has[i]]
                edits = []
                for i in live:
                    cut = len(lasts[i]) // 4
                    edits.append(lasts[i][:len(lasts[i]) - cut] + texts[i][:cut])
                found = digests(texts + edits)
                own, changed = found[:len(texts)], found[len(texts):]
                rows = []
                for i, edit, near in zip(live, edits, changed, strict=True):
                    if i and lasts[i] == texts[i - 1]:
                        mine = own[i - 1]
                    else:
                        mine = held[1] if held is not None and held[0] == lasts[i] else digests([lasts[i]])[0]
                    rows.append((
                        batch.column(0)[i].as_py(), len(lasts[i]), hashlib.sha256(edit.encode()).hexdigest(), written(mine), written(near),
                        likeness(mine, near), likeness(mine, own[i])))
                held = (texts[-1], own[-1])
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [
                    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return paired.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
