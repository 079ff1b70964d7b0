import os
import random
import unicodedata

import pytest
import zstandard

from tickloom.llm import language as lg
from tickloom.llm.queries import QUERIES

SF = os.environ.get("TICKLOOM_SF_TEXT", "/root/testdata/sf0.01")
SAMPLE = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the whole forest with the other animals ",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann mit den anderen tieren durch den ganzen wald ",
    "fr": "le renard brun rapide saute par dessus le chien paresseux puis il court dans toute la forêt avec les autres animaux ",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(lang, text * 3 + str(k)) for lang, text in SAMPLE.items() for k in range(5)] + [(None, "no language"), ("xx", None), ("yy", "123")]
    return lg.fit(spark.createDataFrame(rows, "lang string, text string"))


def test_what_is_learned(spark, model):
    assert [name for name, _ in model.dictionaries] == ["de", "en", "fr"]
    assert all(len(data) <= lg.DICTIONARY_BYTES for _, data in model.dictionaries)
    again = lg.fit(spark.createDataFrame([(lang, text * 3 + str(k)) for k in range(5) for lang, text in SAMPLE.items()], "lang string, text string").repartition(3))
    assert again == model


def test_copies_do_not_shrink_the_sample(spark):
    texts = [f"{SAMPLE['en']} {chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(50)]
    rare = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    often = rare.crossJoin(spark.range(200).select())
    assert lg.fit(often) == lg.fit(rare) and lg.fit(rare).dictionaries
    # One large group of copies takes no place from the different texts.
    others = spark.createDataFrame([("en", f"{SAMPLE['en']} {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}y") for k in range(2000)], "lang string, text string")
    skewed = others.union(spark.range(20_000).selectExpr("'en'", "'one text that is copied very often'"))
    learned = lg.fit(skewed, rows=100, size=10**6).dictionaries[0][1].decode()
    assert 60 < sum(w.endswith("y") and len(w) == 4 and w != "lazy" for w in learned.split()) < 140


def test_predictions_and_rejection(model):
    judge = lg.Classifier(model)
    assert judge.predict("Über den faulen Hund springt der FUCHS und läuft!", 0.004)[0] == "de"
    assert judge.predict("dans toute la forêt le chien paresseux", 0.004)[0] == "fr"
    assert judge.predict(None, 0.004) == judge.predict("12 !!", 0.004) == (lg.UNKNOWN, 0.0, True)
    name, score, rejected = judge.predict("zq", 0.004)
    assert name in SAMPLE and 0 <= score <= 1 and rejected == (score < 0.004)
    assert judge.predict(SAMPLE["de"], 1.1)[2] and not judge.predict(SAMPLE["de"], 0.0)[2]


def test_the_end_of_a_long_text_counts(model):
    assert lg.Classifier(model).predict(SAMPLE["en"] * 20 + SAMPLE["fr"] * 200, 0.004)[0] == "fr"


def test_awkward_rows(spark, awkward, nothing, model):
    rows = lg.predict(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["text"] in (None, "", "!!! ... 123")} == {lg.UNKNOWN}
    kept = lg.keep_identified(awkward, model)
    assert kept.columns == awkward.columns and kept.schema == awkward.schema
    assert not any(r["text"] in (None, "", "!!! ... 123") for r in kept.collect())
    assert lg.predict(nothing, model).collect() == [] and lg.fit(nothing).dictionaries == ()
    assert {r["lang_pred"] for r in lg.predict(awkward, lg.fit(nothing)).collect()} == {lg.UNKNOWN}


def brute(text, dictionaries):
    """(language, score) by one fresh compressor a block and language."""
    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return lg.UNKNOWN, 0.0
    plain = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
    sizes = {}
    for name, data in dictionaries:
        sizes[name] = 0
        for k in range(0, len(plain), lg.BLOCK_BYTES):
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=lg.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] += len(press.compress(plain[k:k + lg.BLOCK_BYTES]))
    first, second = sorted((n, name) for name, n in sizes.items())[:2]
    return first[1], (second[0] - first[0]) / second[0]


def test_table_against_brute_force(spark, model):
    rng = random.Random(3)
    words = {lang: text.split() for lang, text in SAMPLE.items()}
    texts = [" ".join(rng.choice(words[rng.choice([lang, "en"])]) for _ in range(rng.choice([1, 5, 40, 1500]))) for lang in SAMPLE for _ in range(15)]
    texts += [None, "", "² ½ ①", "7 % !", "é", "Über-Wald, 3 Füchse; ça", "ª", "日本語", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in lg.predict(docs, model).collect()}
    for k, text in enumerate(texts):
        name, score = brute(text, model.dictionaries)
        assert got[k] == (name, pytest.approx(score), name == lg.UNKNOWN or score < lg.MIN_MARGIN), text


def test_too_many_languages_are_refused(spark):
    many = spark.range(lg.MAX_LANGUAGES + 1).selectExpr("concat('l', id) AS lang", "concat('some text ', id) AS text")
    with pytest.raises(ValueError):
        lg.fit(many)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_compression_language"](spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) < 0.02 * len(rows)
