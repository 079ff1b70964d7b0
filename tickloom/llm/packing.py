"""Vector best-fit packing of token pieces into sequences.

A piece asks for a vector (tokens, 1 document, attention cost = tokens squared) of a sequence's
capacities.  The vector follows from the piece's length alone, so all there is to decide is how many
pieces of each length go together: the driver gets one count per length (at most `tokens` of them,
however large the corpus), runs vector best-fit decreasing on the counts, and returns ranges
"these ranks of this length go to these sequences".  Spark ranks the pieces and joins the ranges.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.batches import give_back, slices
from tickloom.llm.pretokens import word_level
from tickloom.llm.store import table

#: Words and their characters that a worker remembers at most, and the longest of them.
REMEMBERED, REMEMBERED_CHARS, SHORT = 200_000, 3_000_000, 64
#: Least and most pieces of one length that are ranked together; a length has as many parts as its count asks for.
PART_ROWS = (1 << 8, 1 << 17)


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence; by default documents and attention never bind before tokens do."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def piece(self) -> int:
        """The longest piece that fits a sequence alone."""
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("every capacity must be at least 1")
        return min(self.tokens, math.isqrt(self.attention))


class WordIds:
    """Token ids of whole texts as little-endian 32-bit numbers; the library encodes each new word once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, from one text that holds them all; a space is no token and parts words."""
        coded = self.library.encode(" ".join(words), add_special_tokens=False)
        of_word = np.array(coded.word_ids, np.int64)
        cuts = np.flatnonzero(np.diff(of_word)) + 1
        if len(cuts) + 1 != len(words):
            return self._by_library(words)
        data, ends = np.array(coded.ids, "<u4").tobytes(), [0, *(4 * cuts).tolist(), 4 * len(of_word)]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Words do not depend on their neighbours; texts with special tokens or beyond Latin letters go whole to the library."""
        words = [None if any(s in t for s in self.special) else word_level(t) for t in texts]
        todo = list({w for found in words if found for w in found if w not in self.known})
        new: dict[str, bytes] = {}
        for k in range(0, len(todo), 4096):
            part = todo[k:k + 4096]
            new.update(zip(part, self._words(part), strict=True))
        whole = iter(self._by_library([t for t, found in zip(texts, words, strict=True) if found is None]))
        known = self.known
        out = [next(whole) if found is None else b"".join([known[w] if w in known else new[w] for w in found]) for found in words]
        self._remember({w: ids for w, ids in new.items() if len(w) <= SHORT})
        return out

    def _remember(self, new: dict[str, bytes]) -> None:
        size = sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED or self.held + size > REMEMBERED_CHARS:
            self.known, self.held = {}, 0
        if len(new) <= REMEMBERED and size <= REMEMBERED_CHARS:
            self.known.update(new)
            self.held += size


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(
    df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
    end_id: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then `end_id`, cut every `size` ids.

    A null text is empty: one piece of one id.
    """
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    last = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(public_tokenizers.path(vocabulary))
        for whole in batches:
            for batch in slices(whole, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, coded in enumerate(encoder.texts([t or "" for t in batch.column(1).to_pylist()])):
                    coded += last
                    for k, at in enumerate(range(0, len(coded), 4 * size)):
                        part = coded[at:at + 4 * size]
                        row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary())), names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder.known, encoder.held = {}, 0
        give_back()

    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(counts: dict[int, int], limits: Limits, rule: str = "norm") -> pd.DataFrame:
    """Vector best-fit decreasing on counts of lengths.

    Sequences with the same filling are one group.  Of the groups in which a piece fits under every
    capacity, `norm` takes the one with the smallest weighted norm of what would be left, and `dot` the
    one whose residuals have the largest weighted product with the piece; weights are the shares of all
    demand.  Ties go to the older group.  A row of the result says: ranks [rank, rank + sequences * each)
    of `length` go round robin to `sequences` sequences from `first`, the first copy at `offset`.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    ask = lambda n: np.array([n, 1, n * n], float)
    demand = sum((ask(n) * c for n, c in counts.items()), np.zeros(3)) / caps
    weights = demand / max(demand.sum(), 1e-300)
    left, many, first, used = np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
    groups = sequences = 0
    rows = []

    def fill(length: int, rank: int, count: int, room: np.ndarray, bins: int, start: int, offset: int) -> tuple[int, list]:
        """Fills bins with as many pieces as fit each, then one more bin with what is left; (pieces placed, groups made)."""
        each = int(min(room // ask(length)))
        full = min(bins, count // each)
        made, placed = [], full * each
        if full:
            rows.append((length, rank, full, each, start, offset))
            made.append((room - each * ask(length), full, start, offset + each * length))
        rest = count - placed if full < bins else 0
        if rest:
            rows.append((length, rank + placed, 1, rest, start + full, offset))
            made.append((room - rest * ask(length), 1, start + full, offset + rest * length))
        over = bins - full - (rest > 0)
        if over:
            made.append((room, over, start + bins - over, offset))
        return placed + rest, made

    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        rank, remaining = 0, counts[length]
        need = ask(length)
        while remaining:
            fits = (left[:groups] >= need).all(axis=1) & (many[:groups] > 0)
            if fits.any():
                after = (left[:groups] - need) / caps
                score = (weights * after * after).sum(axis=1) if rule == "norm" else -(weights * left[:groups] / caps * need / caps).sum(axis=1)
                g = int(np.argmin(np.where(fits, score, np.inf)))
                placed, made = fill(length, rank, remaining, left[g], int(many[g]), int(first[g]), int(used[g]))
                many[g] = 0
            else:
                each = int(min(caps // need))
                bins = -(-remaining // each)
                placed, made = fill(length, rank, remaining, caps.copy(), bins, sequences, 0)
                sequences += bins
            rank, remaining = rank + placed, remaining - placed
            for room, n, at, offset in made:
                if (room < ask(smallest)).any():
                    continue
                if groups == len(many):
                    kept = many[:groups] > 0
                    k = int(kept.sum())
                    size = max(64, 2 * k)
                    keep = lambda a: np.concatenate([a[:groups][kept], np.zeros((size - k, *a.shape[1:]), a.dtype)])  # noqa: B023, E731
                    left, many, first, used = keep(left), keep(many), keep(first), keep(used)
                    groups = k
                left[groups], many[groups], first[groups], used[groups] = room, n, at, offset
                groups += 1
    return pd.DataFrame(rows, columns=["length", "rank", "sequences", "each", "first", "place"]).astype("int64")


def plan_frame(spark: SparkSession, plan: pd.DataFrame) -> DataFrame:
    schema = "p_length long, p_rank long, p_sequences long, p_each long, p_first long, p_place long"
    return spark.createDataFrame(plan.itertuples(index=False, name=None), schema) if len(plan) else spark.createDataFrame([], schema)


def pack(pieces: DataFrame, limits: Limits = Limits(), rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces (any frame with a `length` column of 1 .. limits.piece()).

    The frame is written once to the shared folder, since it is read for the counts and for the ranks.
    Equal rows are pieces of their own.  An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    taken = {"sequence_id", "offset", "p_part", "p_base", "p_row"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    # Where a row lies in its task's output tells equal rows apart; written, it is the same for every reader.
    stored = table(pieces.withColumn("p_row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}  # at most `tokens` rows
    if any(n < 1 or n > limits.piece() for n in counts):
        raise ValueError("a piece is longer than a sequence may hold, or empty")
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_rows = min(max(PART_ROWS[0], sum(counts.values()) // tasks), PART_ROWS[1])
    parts = {n: -(-c // part_rows) for n, c in counts.items() if c > part_rows}
    of_length = F.coalesce(F.create_map(*[F.lit(v) for item in parts.items() for v in item])[F.col("length").cast("int")], F.lit(1)) if parts else F.lit(1)
    stored = stored.withColumn("p_part", F.pmod(F.xxhash64("p_row"), of_length).cast("int"))
    by_part = stored.groupBy("length", "p_part").agg(F.count("*").alias("p_rows"))
    before = Window.partitionBy("length").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "p_part", F.coalesce(F.sum("p_rows").over(before), F.lit(0)).alias("p_base"))
    order = Window.partitionBy("length", "p_part").orderBy(*[F.col(c) for c in ("doc_id", "piece") if c in pieces.columns], "p_row")
    ranked = stored.withColumn("p_row", F.row_number().over(order) - 1).join(base, ["length", "p_part"])
    # One row for each step of the packing: at most a few for each of the `tokens` lengths, whatever the corpus.
    plan = F.broadcast(plan_frame(spark, best_fit(counts, limits, rule)))
    rank = F.col("p_base") + F.col("p_row")
    inside = (F.col("p_length") == F.col("length")) & (rank >= F.col("p_rank")) & (rank < F.col("p_rank") + F.col("p_sequences") * F.col("p_each"))
    turn = rank - F.col("p_rank")
    return ranked.join(plan, inside).select(
        *[F.col(c) for c in pieces.columns],
        (F.col("p_first") + turn % F.col("p_sequences")).alias("sequence_id"),
        (F.col("p_place") + F.expr("(p_base + p_row - p_rank) div p_sequences") * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, limits: Limits = Limits(), rule: str = "norm", **options) -> DataFrame:
    """Tokenises, cuts and packs whole documents; see `token_pieces` and `pack`.

    Null ids stay null, repeated rows are packed each, other columns are left out.  An empty table gives an
    empty table; a text of any length is one row's work and becomes as many pieces as it needs.
    """
    return pack(token_pieces(df, limits.piece(), **options), limits, rule)
