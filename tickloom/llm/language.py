"""Language identification by compression with one raw-content dictionary per language.

Text is lower-cased, everything but letters becomes a space, and the result is encoded in blocks, each
with every language's zstandard dictionary.  The language whose dictionary gives the fewest bytes wins;
a prediction whose margin over the second language is narrow is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import give_back, slices

#: Bounds of what is learned: rows and characters of a row per language, bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 1000, 256 * 1024
#: Languages that a model may have: the driver holds a sample of each, a worker a dictionary of each.
MAX_LANGUAGES = 256
#: A block is encoded with a fresh dictionary, so that a long text can't replace it by itself.
BLOCK_BYTES = 4096
#: Share of the second-best size by which the best must be smaller, else the text is rejected.
MIN_MARGIN = 0.004
LEVEL = 6
UNKNOWN = "und"

_OTHERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    return _OTHERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language; at most SAMPLE_ROWS * languages * DICTIONARY_BYTES in all."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
    size: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Learns from a bounded sample of the labelled rows: about `rows` texts per language, `chars` letters of each.

    The sample is every text whose hash lies below rows / (different texts of the language), so it is the
    same on every run and a text that occurs often counts once; a language of at most `rows` different texts
    is learned from all of them.  Rows without text, letters or language teach nothing; without any labelled
    row there is no language and every text is unknown.  More than MAX_LANGUAGES languages are an error.
    """
    labelled = df.select(df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Copies are left out within each task first, and only hashes are shuffled.
    different = labelled.select("lang", F.xxhash64("text").alias("at")).distinct()
    counts = {r[0]: r[1] for r in different.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return LanguageModel(())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled; put rare ones together first")
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))) for lang, n in sorted(counts.items())])
    sample = (
        labelled.filter(place < share).select("lang", F.xxhash64("text").alias("at"), F.substring("text", 1, 4 * chars).alias("text"))
        .groupBy("lang", "at").agg(F.min("text").alias("text")).collect()
    )
    found: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in counts}
    for lang, at, text in sample:
        found[lang].append((at, letters(text)[:chars].encode()))
    # What is nearest to a text costs least to refer to; the order is that of the hashes.
    joined = {lang: b" ".join(t for _, t in sorted(texts))[-size:] for lang, texts in found.items()}
    return LanguageModel(tuple(sorted((lang, data) for lang, data in joined.items() if len(data) >= 8)))


class Classifier:
    def __init__(self, model: LanguageModel):
        self.names = [name for name, _ in model.dictionaries]
        self.encoders = []
        for _, data in model.dictionaries:
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode()
        blocks = [data[k:k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        """(language, margin from 0 to 1, rejected)."""
        if not self.names or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.names[k]))
        others = [s for k, s in enumerate(sizes) if k != best]
        margin = 1.0 if not others else (min(others) - sizes[best]) / max(1, min(others))
        return self.names[best], margin, margin < min_margin


@lru_cache(maxsize=2)
def classifier(model: LanguageModel) -> Classifier:
    return Classifier(model)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (the margin, 0 to 1) and rejected to whole texts; all other columns stay.

    A null text, or one without letters, is `und` with score 0 and rejected.  Of equal sizes the language
    that comes first by name wins, with score 0.  A column named lang_pred, score or rejected is replaced.
    Repeated rows get equal results each, an empty table gives an empty table, and a text of any length is
    one row's work, encoded block by block.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    # A text that stays in the result is sent to Python once.
    at = kept.index(text_col) if text_col in kept and df.schema[text_col].dataType.simpleString() == "string" else len(kept)
    source = df.select(*[df[c] for c in kept], *([] if at < len(kept) else [df[text_col].cast("string").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = classifier(model)
        for whole in batches:
            for batch in slices(whole, at):
                found = [judge.predict(t.as_py(), min_margin) for t in batch.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(kept)], *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                    [*kept, "lang_pred", "score", "rejected"])
        give_back()

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is found with a sufficient margin, with the columns that they came with."""
    names = {c: f"__own_{k}" for k, c in enumerate(df.columns)}
    renamed = df.select(*[df[c].alias(n) for c, n in names.items()])
    kept = predict(renamed, model, names[text_col], min_margin).filter(~F.col("rejected"))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
