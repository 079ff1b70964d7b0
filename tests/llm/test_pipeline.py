import random

import corpus_pipeline
import __spark_entry__ as entry
from tickloom.llm.queries import ORACLE, QUERIES

LANGUAGES = {
    "en": "the quick brown fox jumps over lazy dogs and then runs through whole forests with other animals while rain falls on green hills".split(),
    "de": "der schnelle braune fuchs springt über faule hunde und läuft dann durch ganze wälder mit anderen tieren während regen fällt".split(),
}


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_whole_run(spark, tmp_path):
    rng = random.Random(9)
    say = lambda lang, n: " ".join(rng.choice(LANGUAGES[lang]) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))
    item = say("en", 30)
    docs = [(k, say(("en", "de")[k % 2], 60), ("en", "de")[k % 2], "s", 0) for k in range(40)]
    near = docs[0][1].split()
    near[30] = "other"
    docs += [(100, docs[3][1], "de", "s", 0), (101, " ".join(near), "en", "s", 0), (102, "12 34 !!", "en", "s", 0), (103, None, "en", "s", 0),
             (104, say("en", 20) + " " + item + " " + say("en", 20), "en", "s", 0), (105, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = spark.read.parquet(str(tmp_path / "documents.parquet"))
    current, left = columns, []
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        if name != "packing":
            assert current.columns == columns.columns
            left.append({r["doc_id"] for r in current.collect()})
    assert left[0] == set(range(40)) | {100, 101, 104}
    assert left[1] == set(range(40)) | {104}
    assert left[2] == set(range(40))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(40))


def test_kept_rows_and_repeated_or_missing_ids(spark):
    text = " ".join(LANGUAGES["en"])
    docs = spark.createDataFrame([(2, text, "x"), (1, text, "y"), (1, text, "y"), (None, text, "z"), (None, None, "z")], "doc_id long, text string, class_id string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [docs.collect()[k] for k in (1, 3, 4)]))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").collect() == []


def test_two_texts_under_one_id_are_two_documents(spark):
    first, second = " ".join(LANGUAGES["en"]), " ".join(LANGUAGES["de"])
    rows = [(1, first, "a"), (1, second, "b"), (2, first, "c"), (3, second, "d"), (4, None, "e"), (4, first + " and so on", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["source"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {"a", "b", "e"}


def test_awkward_rows_through_every_stage(spark, awkward, tmp_path):
    spark.createDataFrame([(1, "some words of a benchmark item that nobody wrote down before")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, awkward.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns or name == "packing"
            assert out.count() <= docs.count() or name == "packing"
