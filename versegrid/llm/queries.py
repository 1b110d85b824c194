"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versegrid.llm import (
    decontaminate, fim, language, lm_scoring, mixing, near_dedup, packing, repeated_units, secrets, syncmers, token_files,
    vector_codes, warc,
)
from versegrid.llm.common import crc_mod, table
from versegrid.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS k
  FROM s),
l AS (
  SELECT k, ratio,
         (1.5 * sum(source_size) OVER () - (sum(2.0 * source_size) OVER (ORDER BY k) - 2.0 * source_size))
         / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY k) - weight)) AS level
  FROM o),
t AS (
  SELECT source, source_size, weight,
         least(2.0 * source_size, weight * (SELECT arg_min(level, k) FROM l WHERE level <= ratio))::DOUBLE AS target
  FROM s)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT
              + (u < target / source_size - floor(target / source_size))::BIGINT ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


@register
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    return decontaminate.contamination(docs, items).select("doc_id", "found.*")


ORACLE["op7_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 13) AS span FROM i WHERE len(w) > 0),
iw AS (SELECT item_id, span, array_to_string(w[s:s + span - 1], ' ') AS run
       FROM il, LATERAL (SELECT unnest(range(1, len(w) - span + 2)) AS s)),
dw AS (SELECT r, s, span, array_to_string(w[s:s + span - 1], ' ') AS run
       FROM d, (SELECT DISTINCT span FROM iw) n, LATERAL (SELECT unnest(range(1, len(w) - span + 2)) AS s)),
m AS (SELECT DISTINCT r, s, dw.span, item_id FROM dw JOIN iw USING (span, run)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM m, LATERAL (SELECT unnest(range(s, s + span)) AS p) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT coalesce(item_id::VARCHAR, ''), ',' ORDER BY coalesce(item_id::VARCHAR, '')) AS listed
        FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


@register
def op10_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Syncmer fingerprints of every text and its edited text."""
    return syncmers.fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@register
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_index(token_files.write_tokens(docs, tokenizer, token_files.default_folder(spark)))


@register
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_spans(table(spark, folder, "documents"))


@register
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document, on four-word shingles."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=4).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


ORACLE["op2_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 4) - 1], ' ') AS g
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 4) + 2)) AS s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@register
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, written to archives and read back."""
    archives = staging_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    return warc.page_records(warc.read_archives(spark, archives))


ORACLE["op3_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1), '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p
"""


@register
def op5_repeated_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every line or sentence that repeats an earlier one, with its offsets and those of the one kept."""
    return repeated_units.repeated(table(spark, folder, "documents").select("doc_id", "text"))


@register
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; two thirds of the documents train."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    learned = language.prototypes(docs.filter(~held_out))
    return language.predictions(docs, learned, "doc_id", "text", held_out.alias("held_out"))


@register
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Base and interpolated score of every document; six sevenths of the documents train."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm_scoring.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2).select(
        F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into sequences of power-of-two lengths, from the stored sequences."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sequences = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed_pieces(sequences).withColumnRenamed("key", "doc_id")


@register
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of every vector, and what they lose."""
    coded, books = vector_codes.vector_codes(table(spark, folder, "embeddings"))
    return coded.select(F.col("key").alias("vec_id"), "code", "error", "label_error",
                        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _code_rounds() -> str:
    """One pair of tables per round: choices ``a`` of every part, and the entries ``b`` they lead to."""
    def choose(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, min(far * 256 + entry) % 256 AS entry, min(far * 256 + entry) // 256 AS far FROM (
    SELECT p.vec_id, p.label, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM p JOIN b{k} b USING (part)) GROUP BY ALL)"""

    def move(k: int) -> str:
        return f""",
s{k} AS (
  SELECT part, entry, i, sum(x)::BIGINT AS total, count(*)::BIGINT AS n FROM (
    SELECT a.part, a.entry, unnest(range(1, len(p.v) + 1)) AS i, unnest(p.v) AS x FROM a{k} a JOIN p USING (vec_id, part)) GROUP BY ALL),
m{k} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),"""

    return "".join(choose(k) + move(k) for k in range(vector_codes.ROUNDS)) + choose(vector_codes.ROUNDS)


ORACLE["op12_vector_codes"] = f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM q, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v FROM p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM q ORDER BY vec_id LIMIT 256) USING (vec_id)),
{_code_rounds()},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
      FROM a{vector_codes.ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


@register
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every text transformed, and rebuilt from what came out."""
    made = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    back = fim.restore(made, F.col("output"), F.col("form"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias(
        "output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
s AS (
  SELECT *, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS p,
         coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS s
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""
