import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import sharding as sh
from tickloom.llm.store import new_folder


def places(rows):
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in held.values())


def test_bytes_are_near_equal_and_places_gapless(spark):
    rng = random.Random(2)
    rows = [(k, "x" * int(rng.expovariate(1 / 300))) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sh.shard_documents(docs, new_folder(spark, "map")).collect()
    assert len(got) == len(rows) and places(got)
    load = defaultdict(int)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1]) + 16 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode())
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(sh.SHARDS)) and max(load.values()) - min(load.values()) < 0.02 * min(load.values())


def test_whole_table_against_row_loops(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(300) if k % 20 else None, None if k % 17 == 0 else "copy" if k % 3 == 0 else "y" * rng.randrange(90)) for k in range(900)]
    got = sh.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), new_folder(spark, "map"), shards=5, slots=64).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    # The same id and text has one slot, a slot one shard, and places follow slot, id and checksum.
    slot_of, shard_of, held = {}, {}, defaultdict(list)
    for r in got:
        assert slot_of.setdefault((r["doc_id"], r["text_crc32"]), r["vslot"]) == r["vslot"]
        assert shard_of.setdefault(r["vslot"], r["shard"]) == r["shard"]
        held[r["shard"]].append(r)
    for part in held.values():
        part.sort(key=lambda r: (r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
        order = [r["slot"] for r in part]
        assert order == list(range(len(part))) or sorted(order) == list(range(len(part))) and all(
            part[a][k] == part[b][k] for a, b in zip(range(len(part)), order) for k in ("vslot", "doc_id", "text_crc32"))
    loads = [sum(r["size"] for r in part) for part in held.values()]
    biggest = max(sum(r["size"] for r in got if r["vslot"] == v) for v in shard_of)
    assert max(loads) - min(loads) <= biggest


def test_growing_takes_slots_into_the_new_shard_only():
    rng = random.Random(4)
    size, rows = [rng.randrange(1000) for _ in range(4096)], [1] * 4096
    first = sh.SlotMap.balanced(size, rows, 10)
    grown = first.grown()
    moved = [k for k in range(4096) if grown.shard[k] != first.shard[k]]
    assert {grown.shard[k] for k in moved} == {10} and grown.version == 1 and grown.history == ((1, len(moved), sum(size[k] for k in moved)),)
    assert max(grown.loads()) < 1.02 * sum(size) / 11 and min(grown.loads()) > 0.98 * sum(size) / 11


def test_editing_after_growth_of_some_slots():
    size, rows = [100] * 1000, [1] * 1000
    first = sh.SlotMap.balanced(size, rows, 10)
    heavier = [300 if s == 3 else 100 for s in first.shard]
    edited = first.resized(heavier, rows)
    assert max(edited.loads()) <= 1.02 * sum(heavier) / 10 + 300
    assert {first.shard[k] for k in range(1000) if edited.shard[k] != first.shard[k]} == {3}
    assert first.resized(size, rows).shard == first.shard


def test_versions_are_stored(spark):
    path = new_folder(spark, "map")
    first = sh.SlotMap.balanced([5, 4, 3, 2, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0, 0], 2)
    first.save(spark, path)
    first.grown().save(spark, path)
    assert sh.SlotMap.load(spark, path, 0) == first
    assert sh.SlotMap.load(spark, path, 1).shard == first.grown().shard
    with pytest.raises(Exception):
        first.save(spark, path)
    # The last shards may be empty.
    sparse = sh.SlotMap.balanced([9, 0], [1, 0], 5)
    other = new_folder(spark, "map")
    sparse.save(spark, other)
    assert sh.SlotMap.load(spark, other, 0) == sparse and sh.SlotMap.load(spark, other, 0).shards == 5


def test_a_record_finds_its_shard_in_an_edited_map(spark):
    path = new_folder(spark, "map")
    docs = spark.createDataFrame([(k, "x" * (k % 700)) for k in range(5000)], "doc_id long, text string")
    before = {r["doc_id"]: r["shard"] for r in sh.shard_documents(docs, path, shards=8).collect()}
    sh.SlotMap.load(spark, path, 0).grown().save(spark, path)
    after = sh.assign(sh.slotted(docs), spark.read.parquet(f"{path}/version=000001")).collect()
    assert len(after) == 5000 and places(after)
    assert {r["shard"] for r in after if r["shard"] != before[r["doc_id"]]} == {8}


def test_awkward_rows(spark, awkward, nothing):
    got = sh.shard_documents(awkward, new_folder(spark, "map"), shards=3).collect()
    assert len(got) == awkward.count() and places(got)
    assert [r["size"] for r in got if r["doc_id"] == 5] == [16] and [r["text_crc32"] for r in got if r["doc_id"] == 5] == [0]
    assert sh.shard_documents(nothing, new_folder(spark, "map")).collect() == []
    same = spark.createDataFrame([(1, "a")] * 30, "doc_id long, text string")
    got = sh.shard_documents(same, new_folder(spark, "map"), shards=3).collect()
    assert len(got) == 30 and places(got)
    with pytest.raises(ValueError):
        sh.SlotMap.balanced([1], [1], 0)


def test_the_slot_of_a_record_does_not_change(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["vslot"] for r in sh.slotted(docs).collect()}
    b = {r["doc_id"]: r["vslot"] for r in sh.slotted(docs.filter("doc_id % 3 = 0").repartition(5)).collect()}
    assert all(a[k] == s for k, s in b.items())
