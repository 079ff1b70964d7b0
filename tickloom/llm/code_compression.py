"""Short codes for vectors: one codebook per part of the vector, learned by ball k-means in whole numbers.

A component x becomes floor(scale * x), and a vector is cut into equal consecutive parts.  Every part has a
codebook of entries; a round assigns each part to its nearest entry and moves every entry to the floor of
the mean of its parts.

Nearest entries are found by balls.  A part starts from a reference entry: the one that it had in the round
before, at first the one nearest in the sum of its components.  The parts that refer to an entry form its
ball.  Only entries nearer to it than twice the ball's radius are its neighbours.  A part within half the
distance to the nearest neighbour lies in the stable core and keeps its entry without a comparison; any
other part is compared with the neighbours up to its own ring, those no farther than twice its own
distance.  An entry beyond that can neither win nor tie, so the result is that of comparing all entries.
All arithmetic is on 64-bit whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import table

#: Vectors that are assigned at a time.
ROWS = 8192
_COMPONENT_LIMIT = 1 << 30


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of every row of `x`, of equal ones that of the lower index.

    `x` is (rows, width), `book` (entries, width); `start` holds a reference entry per row.
    """
    size = len(book)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    rank = between.copy()
    np.fill_diagonal(rank, -1)  # an entry comes first among its own neighbours, copies of it after it
    order = np.argsort(rank, axis=1, kind="stable")
    apart = np.take_along_axis(between, order, axis=1)
    if start is None:
        sums = book.sum(axis=1)
        by_sum = np.argsort(sums, kind="stable")
        place = np.minimum(np.searchsorted(sums[by_sum], x.sum(axis=1)), size - 1)
        start = by_sum[place]
    own = ((x - book[start]) ** 2).sum(axis=1)
    radius = np.zeros(size, np.int64)
    np.maximum.at(radius, start, own)
    neighbours = (apart <= 4 * radius[:, None]).sum(axis=1)
    best, code = own.copy(), start.astype(np.int64)
    live = np.arange(len(x))
    for ring in range(1, size):
        entry = start[live]
        # Rings are in order of distance, so a row that is through with one is through with all behind it.
        live = live[(ring < neighbours[entry]) & (apart[entry, ring] <= 4 * own[live])]
        if not len(live):
            break
        other = order[start[live], ring]
        distance = ((x[live] - book[other]) ** 2).sum(axis=1)
        better = (distance < best[live]) | ((distance == best[live]) & (other < code[live]))
        rows = live[better]
        best[rows], code[rows] = distance[better], other[better]
    return code, best


@dataclass(frozen=True)
class Codebooks:
    """Entries as (parts, entries, width) whole numbers."""

    entries: np.ndarray

    def assign(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of vectors given as (rows, parts, width), both (rows, parts)."""
        codes, errors = np.zeros(x.shape[:2], np.uint8), np.zeros(x.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            codes[:, p], errors[:, p] = nearest(x[:, p], book, None if start is None else start[:, p].astype(np.int64))
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale < _COMPONENT_LIMIT, y.cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for whole-number codes")).cast("int"))

    return F.transform(vector, one)


def _cube(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _assigned(rows: DataFrame, books: Codebooks, parts: int, first: bool) -> DataFrame:
    """vec_id, label, q, code, error; `first` says that the rows have no code yet."""
    names = ["vec_id", "label", "q", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                codes, errors = books.assign(_cube(batch.column(2), parts), None if first else _codes(batch.column(3), parts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors.sum(axis=1), pa.int64())], names)

    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names[:3]]
    given = rows.select(*names[:3]) if first else rows.select(*names[:4])
    return given.mapInArrow(run, ", ".join([*kinds, "code binary", "error long"]))


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floor of the mean of their parts; entries without parts stay.

    Tasks send one row per part and entry, so the driver gets parts * entries rows whatever the table.
    """
    parts, size, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        shift = np.arange(parts) * size
        for batch in batches:
            place = (_codes(batch.column(1), parts) + shift).ravel()
            np.add.at(sums, place, _cube(batch.column(0), parts).reshape(-1, width))
            counts += np.bincount(place, minlength=parts * size)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["place", "n", "sums"])

    partial = rows.select("q", "code").mapInArrow(run, "place long, n long, sums array<long>")
    total = partial.groupBy("place").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)])
    moved = books.entries.reshape(parts * size, width).copy()
    for row in total.collect():
        moved[row["place"]] = [int(row[f"s{d}"]) // row["n"] for d in range(width)]
    return Codebooks(moved.reshape(parts, size, width))


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16,
    entries: int = 64, rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code as bytes, error) of every kept vector, and the codebooks; None when nothing is kept.

    A vector that is null or holds a null, NaN or infinite component is left out.  The codebooks start from
    the `entries` smallest ids (fewer if the table has fewer); of equal ids the smaller vector comes first,
    repeated rows count each, and rows without an id are coded but never start an entry, unless no row has
    an id.  Ties go to the lower index.  Vectors of different lengths, or of a length that `parts` does not
    divide, and components of 2**30 / scale and more are an error.  Other columns are left out, so no name
    can clash.  An empty table gives an empty table.  Rows are read in parts of the table in any order: a
    vector or label that holds any share of the rows is no group to anyone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    own = df.select(df[id_col].alias("vec_id"), df[label_col].alias("label"), df[vector_col].alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = own.filter(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    rows = table(kept.select("vec_id", "label", whole_numbers(F.col("v"), scale).alias("q")), "vectors")
    facts = rows.agg(F.min(F.size("q")).alias("low"), F.max(F.size("q")).alias("high"), F.max(F.array_max(F.transform("q", F.abs))).alias("most")).first()
    if facts["low"] is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    if facts["low"] != facts["high"] or facts["low"] % parts:
        raise ValueError(f"vectors must have one length that {parts} divides")
    if 16 * facts["low"] * (facts["most"] or 0) ** 2 >= 1 << 62:
        raise ValueError("components are too large for whole-number distances")
    with_id = rows.filter(F.col("vec_id").isNotNull())
    seeds = with_id.orderBy("vec_id", "q").limit(entries).collect() or rows.orderBy("q").limit(entries).collect()
    start = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), parts, -1)
    books, first = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2))), True
    for k in range(rounds):
        rows = table(_assigned(rows, books, parts, first), f"codes-{k}")
        books, first = _moved(rows, books), False
    return _assigned(rows, books, parts, first).select("vec_id", "label", "code", "error"), books


def compressed_table(df: DataFrame, **options) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (error over equal labels, nulls together), codebooks_sha256."""
    coded, books = compress(df, **options)
    coded = table(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return coded.join(table(totals, "label-errors"), F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
