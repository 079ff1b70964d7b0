"""Near duplicates by BagMinHash signatures, bands, and a check of the multiset overlap.

A text is a bag of word 5-shingles with their counts as weights.  Weights are discretised to whole
numbers and grouped in levels [0, 1), [1, 2), [2, 4), [4, 8) ...: every shingle has one Poisson process
per level, whose points have an arrival time, a register, and a place in the level that is halved down
to one whole weight.  A point counts for a bag if its place lies below the shingle's weight there, and a
register keeps the earliest point that counts.  So two bags agree in a register with probability
sum(min) / sum(max) of their weights, their weighted Jaccard likeness.  Only points before the latest
register can matter: nearly all shingles of a text draw one number and are done.

Texts that are equal byte for byte are one text from the start.  Bands of equal registers make buckets.
In a bucket every text is compared with the bucket's leader.  Where the texts around a leader are then not
yet one class, those outside the largest class are compared with all others, in cells of bounded size that
hold two blocks of texts each.  So no bucket emits its pairs, no task holds a whole group, and no pair of a
bucket that could join two classes stays untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import give_back
from tickloom.llm.store import table
from tickloom.llm.words import groups_of_texts, mix, shingle_hashes, text_bytes, uniform, word_hashes

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 6 registers: a pair at 0.8 shares a bucket with probability 0.99994, one at 0.4 with 0.12.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Texts and bytes of a block; a cell holds two.
CELL_TEXTS, CELL_BYTES = 128, 16 << 20
_LEVEL, _STEP = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xDB4F0B9175AE2165)


def bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle numbers, counts) of the bytes of one text."""
    words, _ = word_hashes(data)
    return np.unique(shingle_hashes(words, SHINGLE_WORDS), return_counts=True)


def _levels(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, seed, low, width, weight) of every level that reaches below a weight."""
    out = [(owner, mix(shingles), np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64), weights)]
    level, low = 1, 1
    while True:
        more = weights > low
        if not more.any():
            break
        out.append((owner[more], mix(shingles[more] + np.uint64(int(_LEVEL) * level % (1 << 64))), np.full(more.sum(), low), np.full(more.sum(), low), weights[more]))
        level, low = level + 1, low * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Registers of every non-empty bag, one row each: the number of the point that each register keeps."""
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(s) for s, _ in bags])
    shingles, weights = np.concatenate([s for s, _ in bags]), np.concatenate([w for _, w in bags]).astype(np.int64)
    total = np.bincount(owner, weights, n)
    parts = _levels(shingles, weights, owner)
    kept = np.zeros((n, registers), np.uint64)
    # All registers of most bags are filled by then; the others go on with twice the time.
    until = (np.log(registers) + 3.0) / total
    todo = np.arange(n)
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        take = chosen[parts[0]]
        time, point = _arrivals(tuple(p[take] for p in parts), until, n, registers)
        full = np.isfinite(time[todo]).all(axis=1)
        kept[todo[full]] = point[todo[full]]
        todo = todo[~full]
        until = until * 2
    return kept


def _arrivals(parts: tuple[np.ndarray, ...], until: np.ndarray, n: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    owner, seed, low, width, weight = parts
    first = np.full(n * registers, np.inf)
    point = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(owner))
    done, block = 0, 1
    while len(owner):
        # The next `block` points of every process that is still before its text's end.
        number = np.arange(done + 1, done + block + 1, dtype=np.uint64)
        draw = mix(seed[:, None] + _STEP * number[None, :])
        gaps = -np.log(uniform(draw)) / (registers * width)[:, None]
        times = np.cumsum(np.concatenate([at[:, None], gaps], axis=1), axis=1)[:, 1:]
        row, col = np.nonzero(times <= until[owner][:, None])
        t, name = times[row, col], mix(draw[row, col] ^ _LEVEL)
        place = low[row] + (name >> np.uint64(32)).astype(np.int64) % width[row]
        counts = place < weight[row]
        slot = (owner[row] * registers + (name & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers)[counts]
        t, name = t[counts], name[counts]
        np.minimum.at(first, slot, t)
        win = first[slot] == t
        point[slot[win]] = name[win]
        going = times[:, -1] <= until[owner]
        owner, seed, low, width, weight, at = (a[going] for a in (owner, seed, low, width, weight, times[:, -1]))
        done, block = done + block, min(64, 2 * block)
    return first.reshape(n, registers), point.reshape(n, registers)


def band_keys(kept: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = kept.reshape(len(kept), bands, -1)
    out = np.zeros(rows.shape[:2], np.uint64)
    for k in range(rows.shape[2]):
        out = mix(out * _STEP + rows[:, :, k])
    return out.view(np.int64)


def _signed(source: DataFrame) -> DataFrame:
    """(id, digest, size, bands) of every text; a text without words has no bands."""
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, offsets = text_bytes(whole.column(2))
            for a, b in groups_of_texts(offsets):
                bags = [bag(data[offsets[k]:offsets[k + 1]]) for k in range(a, b)]
                filled = [k for k, (s, _) in enumerate(bags) if len(s)]
                keys = band_keys(signatures([bags[k] for k in filled])) if filled else np.zeros((0, BANDS), np.int64)
                sizes = np.zeros(b - a + 1, np.int32)
                sizes[1:][filled] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.reshape(-1)))
                part = whole.slice(a, b - a)
                bytes_of = pa.array(np.diff(offsets[a:b + 1]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bytes_of, lists], ["id", "digest", "size", "bands"])
        give_back()

    return source.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest string, size long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts whose bags overlap by the threshold or more."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            if text not in cache:
                if len(cache) >= 64:
                    cache.clear()
                cache[text] = bag(np.frombuffer(text.encode(), np.uint8))
            return cache[text]

        for frame in frames:
            keep = []
            for x, y in zip(frame["text_a"], frame["text_b"], strict=True):
                (s, m), (t, n) = of(x), bag(np.frombuffer(y.encode(), np.uint8))
                _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                both = int(np.minimum(m[i], n[j]).sum())
                keep.append(both >= THRESHOLD * (int(m.sum()) + int(n.sum()) - both))
            yield frame.loc[keep, ["a", "b"]]
        cache.clear()
        give_back()

    own = texts.select(F.col("id").alias("__id"), "text")
    with_b = pairs.join(own, F.col("b") == F.col("__id")).select("a", "b", F.col("text").alias("text_b"))
    with_a = with_b.join(own, F.col("a") == F.col("__id")).select("a", "b", F.col("text").alias("text_a"), "text_b")
    return with_a.mapInPandas(run, f"a {kind}, b {kind}")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class) for every id of `nodes`: class is the smallest id that links (a, b) lead to.

    Each round every node takes the smallest label among its own and its neighbours', and then its label's
    label, so distances halve; rounds end when no label changes.  Each round's labels are a written table.
    """
    both = table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = low.select(F.col("id").alias("__top"), F.col("label").alias("__up"))
        # A label is the id of a node that has links itself, so the join keeps every row.
        jumped = low.join(up, F.col("label") == F.col("__top")).select("id", F.least("label", "__up").alias("label"), "was")
        labels = table(jumped, "labels")
        if not labels.filter("label < was").head(1):
            break
        labels = labels.drop("was")
    return nodes.join(labels.select(F.col("id").alias("__linked"), "label"), F.col("id") == F.col("__linked"), "left").select(
        "id", F.coalesce("label", "id").alias("class"))


def _shared(buckets: DataFrame) -> DataFrame:
    """(band, key, id, size, leader) of the buckets with more than one text.

    The leader is the text that meets the most others over all bands: the centre of a group of copies is
    near more of them than one of its rims, and it leads in most bands, so pairs repeat.
    """
    counts = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = table(buckets.join(counts, ["band", "key"]), "shared")
    score = met.groupBy("id").agg(F.sum("n").alias("score"))
    leaders = met.join(score, "id").groupBy("band", "key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("leader"))
    return met.select("band", "key", "id", "size").join(leaders, ["band", "key"])


def _star(shared: DataFrame) -> DataFrame:
    """Each bucket's leader `a` paired with every other text `b` of it, with the size of `b`."""
    return shared.filter("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.max("size").alias("size"))


def _cells(star: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, cell, id, class): the texts that must still be compared, dealt into cells of bounded size.

    Everything that shares a bucket with the leader `a` of that bucket is in the star of `a`, so a star holds
    all pairs of its buckets.  In a star of several classes the largest class is cut into blocks, the
    rest is cut into blocks, and a cell is a block of the rest beside one block of either kind: all
    pairs but those inside the largest class, which are joined already, lie in some cell.
    """
    heads = star.select("a").distinct().join(sizes, F.col("a") == F.col("id")).select("a", "id", "size")
    members = star.select("a", F.col("b").alias("id"), "size").unionByName(heads).join(classes, "id")
    per_class = members.groupBy("a", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    per_star = per_class.groupBy("a").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"), F.max(F.struct("n", "class", "bytes")).alias("top"),
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes"),
    ).filter("classes > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / CELL_TEXTS), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    cuts = per_star.select(
        "a", "main", blocks(F.col("top.n"), F.col("top.bytes")).alias("mains"),
        blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rests"))
    # Written, so that the join below reads two plain shuffles, of which Spark can split a star that is large.
    cuts = table(cuts, "cuts")
    dealt = members.join(cuts, "a")
    is_main = F.col("class") == F.col("main")
    mine = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    beside_main = F.transform(every(F.col("rests")), lambda k: cell(0, F.col("mine"), k))
    beside_rest = F.concat(
        F.transform(every(F.col("mains")), lambda k: cell(0, k, F.col("mine"))),
        # Two blocks of the rest; one alone is compared in every cell that it is in.
        F.transform(F.filter(every(F.col("rests")), lambda k: k != F.col("mine")), lambda k: cell(1, F.least(k, F.col("mine")), F.greatest(k, F.col("mine")))))
    placed = dealt.withColumn("mine", mine).withColumn("is_main", is_main)
    return placed.select("a", F.explode(F.when(F.col("is_main"), beside_main).otherwise(beside_rest)).alias("cell"), "id", "class")


def _links_in_cells(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join classes, found by comparing all texts of a cell at once.

    Shared shingles are counted by a matrix product over those that occur in two texts or more; of the
    links between the same classes one is returned, which joins them just as well.
    """
    kind = texts.schema["id"].dataType.simpleString()
    own = texts.select(F.col("id").alias("__id"), "text")
    filled = cells.join(own, F.col("id") == F.col("__id")).select("a", "cell", "id", "class", "text")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, labels = frame["id"].to_numpy(), frame["class"].to_numpy()
        shared, sizes = shared_shingles([bag(np.frombuffer(t.encode(), np.uint8)) for t in frame["text"]])
        near = (shared >= THRESHOLD * (sizes[:, None] + sizes[None, :] - shared)) & (labels[:, None] < labels[None, :])
        x, y = np.nonzero(near)
        top = {c: c for c in labels.tolist()}

        def find(c: int) -> int:
            while top[c] != c:
                c = top[c]
            return c

        kept = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(labels[i]), find(labels[j])
            if p != q:
                top[max(p, q)] = min(p, q)
                kept.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return filled.groupBy("a", "cell").applyInPandas(compare, f"a {kind}, b {kind}")


def shared_shingles(bags: list[tuple[np.ndarray, np.ndarray]], columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(multiset overlap of every two bags, size of every bag)."""
    sizes = np.array([int(n.sum()) for _, n in bags])
    row = np.repeat(np.arange(len(bags)), sizes)
    # The second, third ... of equal shingles are shingles of their own, so overlaps of counts are overlaps of sets.
    numbers = np.concatenate([np.repeat(s, n) for s, n in bags]) if bags else np.zeros(0, np.uint64)
    turns = [np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) for _, n in bags]
    numbers = numbers + np.concatenate(turns).astype(np.uint64) * _STEP if bags else numbers
    _, at, often = np.unique(numbers, return_inverse=True, return_counts=True)
    keep = often[at] > 1
    rank = np.cumsum(often > 1) - 1
    row, at = row[keep], rank[at[keep]]
    shared = np.zeros((len(bags), len(bags)))
    for start in range(0, int((often > 1).sum()), columns):
        part = (at >= start) & (at < start + columns)
        held = np.zeros((len(bags), columns), np.float32)
        held[row[part], at[part] - start] = 1
        shared += held @ held.T
    return shared, sizes


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows as (id, digest) and their texts as (digest, text_id, node, class): one row per different text.

    `text_id` is the smallest id of a text, `node` a number of its own also where one id has several texts,
    and `class` the smallest node of its class.
    """
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].cast("long").alias("id"), text_digest(docs[id_col], text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    signed = table(_signed(source), "signed")
    known = signed.filter(F.col("id").isNotNull())
    # Copies are put together before anything is shuffled on: one row per text and task leaves the scan.
    groups = table(known.groupBy("digest").agg(F.min("id").alias("text_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "texts")
    several = groups.groupBy("text_id").count().filter("count > 1").select(F.col("text_id").alias("__several"))
    # Below all 32-bit ids, from 60 bits of the digest.
    own = -F.conv(F.substring(F.md5("digest"), 1, 15), 16, 10).cast("long") - F.lit(1 << 32)
    groups = groups.join(several, F.col("text_id") == F.col("__several"), "left").withColumn(
        "node", F.when(F.col("__several").isNull(), F.col("text_id")).otherwise(own)).drop("__several")
    groups = table(groups, "nodes")
    buckets = groups.select(F.col("node").alias("id"), "size", F.posexplode("bands").alias("band", "key"))
    star = table(_star(_shared(buckets)), "star")
    touched = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()
    wanted = groups.join(touched, groups["node"] == touched["id"], "left_semi").select(
        "node", F.col("text_id").alias("__id"), F.col("digest").alias("__digest"))
    texts = source.join(wanted, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest"))).select("node", "text")
    texts = table(texts.dropDuplicates(["node"]).select(F.col("node").alias("id"), "text"), "candidates")
    links = table(_verified(star.select("a", "b"), texts), "links")
    nodes = texts.select("id")
    classes = table(components(nodes, links), "classes")
    sizes = groups.select(F.col("node").alias("id"), "size")
    cells = table(_cells(star, sizes, classes), "cells")
    if cells.head(1):
        found = table(_links_in_cells(cells, texts), "links")
        if found.head(1):
            classes = table(components(nodes, links.union(found)), "classes")
    of_text = groups.select("digest", "text_id", "node").join(classes.select(F.col("id").alias("__id"), "class"), F.col("node") == F.col("__id"), "left")
    return signed.select("id", "digest"), of_text.select("digest", "text_id", "node", F.coalesce("class", "node").alias("class"))


def text_digest(id_col: Column, text: Column) -> Column:
    """What tells texts apart; a null text is one of its own per id."""
    return F.when(text.isNull(), F.concat(F.lit("null "), F.coalesce(id_col.cast("string"), F.lit("")))).otherwise(F.md5(text))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_id, class_id) of every row with an id: the smallest id with the same text, and that of its class.

    Classes are the connected components of texts with a multiset likeness of 0.8 or more.  Equal texts
    are always together, also empty ones and ones without words; texts without words are near no other.  A null text
    is a class of its own by id, and so is a row whose id is null (its results are null).  Rows with the
    same id and text give a row each; if one id has several texts, each of them has its own class, which other
    classes may share the name of.  Ids are whole numbers; other columns play no part.  A text of any length is
    read in pieces.  An empty table gives an empty table.
    """
    rows, of_text = classes_of(docs, id_col, text_col)
    names = of_text.groupBy("class").agg(F.min("text_id").alias("class_id"))
    of_text = of_text.join(names, "class").select(F.col("digest").alias("__digest"), "text_id", "class_id")
    return rows.join(of_text, F.col("digest") == F.col("__digest"), "left").select(F.col("id").alias("doc_id"), "text_id", "class_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of one text of each class, that with the smallest id (of several with that id, the smaller digest)."""
    _, of_text = classes_of(docs, id_col, text_col)
    return of_text.groupBy("class").agg(F.min(F.struct("text_id", "digest")).alias("top")).select(
        F.col("top.text_id").alias("id"), F.col("top.digest").alias("digest"))
