"""Benchmark decontamination with DataFrame functions only: no Python on the path of the data.

Words are lower-cased (A-Z only) runs of digits, letters and characters beyond ASCII.  A window is ten
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.  Every window
of every document is held against a hash set of all item windows, and a hit is verified on the words
themselves.  The scan looks up half windows first: of the runs of half a window that start inside a
window, exactly one starts at a document word 1, 1 + stride, 1 + 2 stride ..., so looking up those alone
misses nothing, and only where one is found are the whole windows around it cut out and looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import table

WINDOW = 10
#: Largest set of item windows, in bytes of their words, that is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lower-cased.
_RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BREAKS), lambda w: w != "")


def _cut(words: Column, size: Column | int) -> Column:
    """Every run of `size` consecutive words, joined by a space; null if there are fewer.

    The words are bound as a variable of the outer function: named as a column inside the inner one, the
    optimiser would put their whole expression there and split the text anew for every run.
    """
    bound = F.transform(
        F.array(words),
        lambda held: F.when(
            F.size(held) >= size,
            F.transform(F.sequence(F.lit(1), F.size(held) - size + 1), lambda i: F.array_join(F.slice(held, i, size), " "))),
    )
    return F.element_at(bound, 1)


def _probes(words: Column, size: int, gram: int, stride: int) -> Column:
    """(at, gram, around) for every `stride` words: a run of `gram` words, and the words of all windows in
    which it is the one that is looked up; `at` is the place of the first of them."""
    def probe(held: Column, p: Column) -> Column:
        at = F.greatest(p - (stride - 1), F.lit(1))
        return F.struct(
            at.alias("at"), F.array_join(F.slice(held, p, gram), " ").alias("gram"), F.slice(held, at, p - at + size).alias("around"))

    bound = F.transform(
        F.array(words),
        lambda held: F.when(
            F.size(held) >= size,
            F.transform(F.sequence(F.lit(1), F.size(held) - (gram - 1), F.lit(stride)), lambda p: probe(held, p))),
    )
    return F.element_at(bound, 1)


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, size, items): each distinct window once, with the items that hold it."""
    words = items.select(items[item_col].alias("item"), words_of(items[text_col]).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    exploded = words.select("item", size.alias("size"), F.explode(_cut(F.col("words"), size)).alias("window"))
    return exploded.groupBy("window", "size").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, at, size, window) of every item window in every document; `at` counts words from 1."""
    spark = docs.sparkSession
    windows = windows.select("window", F.col("size").cast("int").alias("size"))
    facts = windows.groupBy("size").agg(F.sum(F.length("window") + 64).alias("bytes")).collect()
    sizes, held = sorted(r["size"] for r in facts), sum(r["bytes"] for r in facts)
    words = docs.select(*[docs[k] for k in keys], words_of(docs[text_col]).alias("__words"))
    key_columns = [F.col(k) for k in keys]
    if not sizes:
        nothing = spark.createDataFrame([], "at int, size int, window string")
        return words.select(*key_columns).limit(0).join(nothing, F.lit(False), "inner")
    within = held <= BROADCAST_BYTES
    found = None
    for size in sizes:
        # At most WINDOW sizes: those of the items that are shorter than a window are their own.
        gram, stride = (size + 1) // 2, size - (size + 1) // 2 + 1
        own = windows.filter(F.col("size") == size).select(F.xxhash64("window").alias("__hash"), F.col("window").alias("__window"))
        grams = own.select(F.explode(_cut(F.split("__window", " "), gram)).alias("__known")).distinct().withColumn("__key", F.xxhash64("__known"))
        # The outer form: for the inner one the optimiser also filters on the array, and so makes it twice.
        placed = words.select(*key_columns, F.explode_outer(_probes(F.col("__words"), size, gram, stride)).alias("__p")).select(
            *key_columns, F.col("__p.at").alias("__at"), F.col("__p.gram").alias("__gram"), F.col("__p.around").alias("__around"))
        near = placed.join(
            F.broadcast(grams) if within else grams,
            (F.xxhash64("__gram") == F.col("__key")) & (F.col("__gram") == F.col("__known")))
        cut = near.select(*key_columns, "__at", F.posexplode_outer(_cut(F.col("__around"), size)).alias("__step", "__text"))
        part = cut.join(
            F.broadcast(own) if within else own, (F.xxhash64("__text") == F.col("__hash")) & (F.col("__text") == F.col("__window")),
        ).select(*key_columns, (F.col("__at") + F.col("__step")).alias("at"), F.lit(size).alias("size"), F.col("__window").alias("window"))
        found = part if found is None else found.unionByName(part)
    return found


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: n_words, n_hit (words inside any window), n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits.  Rows are told apart by id and text, so repeated
    rows give equal results and a null id is an id like any other.  Items without words, and a null
    item id, match nothing.  An empty table of items leaves every document clean.
    """
    row = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), row.alias("__row"))
    windows = table(item_windows(items.filter(items[item_col].isNotNull()), item_col, item_text_col, window), "windows")
    found = table(hits(base, windows, ["doc_id", "__row"]).distinct(), "hits")
    per_words = (
        found.select("doc_id", "__row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word"))
        .distinct().groupBy("doc_id", "__row").agg(F.count("*").alias("n_hit"))
    )
    per_items = (
        found.select("doc_id", "__row", "window").distinct().join(windows.select("window", "items"), "window")
        .select("doc_id", "__row", F.explode("items").alias("item")).distinct()
        .groupBy("doc_id", "__row").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("ids"))
        .select("doc_id", "__row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    marks = (
        per_words.alias("a").join(per_items.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.__row = b.__row"))
        .select("a.doc_id", "a.__row", "n_hit", "n_items", "items_sha256")
    )
    counted = base.select("doc_id", "__row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return (
        counted.alias("c").join(marks.alias("m"), F.expr("c.doc_id <=> m.doc_id and c.__row = m.__row"), "left")
        .select(
            F.col("c.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Documents without benchmark passages, with the columns they came with.

    `documents` drops a document that holds a window; `spans` cuts the hit words out of it and leaves the
    words around them, joined by one space.  Clean documents stay as they are, byte for byte.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    key = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    base = docs.select(*[docs[c].alias(n) for c, n in own.items()], docs[id_col].alias("doc_id"), key.alias("__row"), docs[text_col].cast("string").alias("__body"))
    windows = table(item_windows(items.filter(items[item_col].isNotNull()), item_col, item_text_col, window), "windows")
    found = hits(base, windows, ["doc_id", "__row"], "__body")
    if mode == "documents":
        bad = table(found.select("doc_id", "__row").distinct(), "hits")
        kept = base.alias("c").join(bad.alias("m"), F.expr("c.doc_id <=> m.doc_id and c.__row = m.__row"), "left_anti")
        return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
    word = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))
    bad = table(found.select("doc_id", "__row", word.alias("word")).groupBy("doc_id", "__row").agg(F.collect_set("word").alias("hit")), "hits")
    joined = base.alias("c").join(bad.alias("m"), F.expr("c.doc_id <=> m.doc_id and c.__row = m.__row"), "left")
    # Tokens with their separators: the split keeps the text's own words, the positions are those of words_of.
    tokens = F.filter(F.split(F.col("__body"), _RAW_BREAKS), lambda w: w != "")
    hit_set = F.map_from_arrays("hit", F.transform("hit", lambda _: F.lit(True)))
    rest = F.filter(tokens, lambda w, i: ~F.coalesce(F.element_at(hit_set, (i + 1).cast("int")), F.lit(False)))
    body = F.when(F.col("hit").isNull(), F.col("__body")).otherwise(F.array_join(rest, " "))
    return joined.select(*[(body if c == text_col else F.col(n)).alias(c) for c, n in own.items()])
