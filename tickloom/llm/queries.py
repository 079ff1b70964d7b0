"""The operators on their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    alignment, chat, code_compression, decontamination, fingerprints, language, main_text, near_duplicates, packing, sentence_pieces, sharding,
    token_counts, warc,
)
from tickloom.llm.store import new_folder, table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(job):
        QUERIES[name] = job
        if oracle:
            ORACLE[name] = oracle
        return job

    return add


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_bagminhash", rf"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, {WORDS_SQL} AS w FROM t),
s AS (SELECT id, g, count(*) AS n FROM (
        SELECT id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
        FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)) GROUP BY id, g),
z AS (SELECT id, sum(n) AS z FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE m >= 0.8 * (x.z + y.z - m)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS top FROM t UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(top) AS class_id FROM r GROUP BY id)
SELECT doc_id, coalesce(t.id, doc_id) AS text_id, coalesce(class_id, doc_id) AS class_id
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.id = t.id
""")
def bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(tables(spark, sf_dir, "documents"))


@query("op3_compression_language")
def compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = language.fit(docs.filter(remainder != 1))
    marked = language.predict(docs.select("doc_id", "text"), model)
    return marked.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_rank_merged_tokens")
def rank_merged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(tables(spark, sf_dir, "documents"))


@query("op9_hashed_decontamination", rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def hashed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


@query("op10_vector_best_fit")
def vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"))


@query("op6_virtual_slots")
def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(tables(spark, sf_dir, "documents"), new_folder(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


#: Both turns of the conversation that holds the template's own marks.
MARKED_TEXT = "\\### Assistant: </turn> ok"


@query("op7_prefix_targets", r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 14
        + length(replace(replace(replace(replace(role, '\', '\e'), '</turn>', '\l/turn>'), '### ', '\h## '), ':', '\c'))
        + length(replace(replace(replace(text, '\', '\e'), '</turn>', '\l/turn>'), '### ', '\h## ')) AS n FROM c),
p AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
    FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""")
def prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    marked = spark.createDataFrame(
        [(-7, 0, "user", MARKED_TEXT), (-7, 1, "assistant", MARKED_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(table(chat.examples(turns.unionByName(marked)), "chat"))


@query("op2_warc_normaliser", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, count(*) OVER (PARTITION BY html) AS n, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1) for k in range(0, 32)], '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
""")
def warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    archives = warc.write_archives(tables(spark, sf_dir, "pages"), f"{folder}/whole")
    index = warc.normalise(archives, f"{folder}/members")
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_recurrent_blocks")
def recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.fit(pages))


@query("op8_improbable_features")
def improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(tables(spark, sf_dir, "documents"))


def code_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The whole of op11 as SQL: every round compares all parts with all entries."""
    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT id, j, v, best % {entries} AS i, best // {entries} AS d FROM (
    SELECT id, j, any_value(x.v) AS v, min({entries} * CAST(list_sum([(x.v[t] - c[t]) * (x.v[t] - c[t]) for t in range(1, len(x.v) + 1)]) AS BIGINT) + i) AS best
    FROM x JOIN b{k} USING (j) GROUP BY id, j))"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS (SELECT b.j, b.i, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT j, i, list((s - ((s % n) + n) % n) // n ORDER BY t) AS c FROM (
        SELECT j, i, t, sum(v[t]) AS s, count(*) AS n FROM (SELECT j, i, v, unnest(range(1, len(v) + 1)) AS t FROM a{k}) GROUP BY j, i, t) GROUP BY j, i) m USING (j, i))"""

    steps = [assigned(0)]
    for k in range(rounds):
        steps += [moved(k), assigned(k + 1)]
    return f"""WITH q AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, [CAST(floor(256 * e) AS BIGINT) for e in embedding] AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
x AS (SELECT id, j, q[j * (len(q) // {parts}) + 1:(j + 1) * (len(q) // {parts})] AS v FROM (SELECT id, q, unnest(range(0, {parts})) AS j FROM q)),
b0 AS (SELECT j, id - 1 AS i, v AS c FROM x WHERE id <= {entries}),
{(',' + chr(10)).join(steps)},
r AS (SELECT id, string_agg(lpad(lower(to_hex(i)), 2, '0'), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, i)) FROM b{rounds}) AS codebooks_sha256
FROM r JOIN q USING (id)"""


@query("op11_ball_code_compression", code_sql())
def ball_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compressed_table(tables(spark, sf_dir, "embeddings"))


@query("op12_spill_counted_alignment")
def spill_counted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(tables(spark, sf_dir, "documents")).documents


@query("op13_merge_round_pieces")
def merge_round_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(tables(spark, sf_dir, "documents"))
