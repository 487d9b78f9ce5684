"""The registered queries of the subpackage: ``opN_name(spark, sf_dir)`` and their DuckDB SQL.

Each query applies its operator to a whole table and derives the digest columns
of its contract from the operator's output.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.llm import (
    fill_middle,
    fuzzy_hash,
    html_density,
    line_dedup,
    minhash,
    packing,
    quality,
    sentencepiece_dropout,
    token_counts,
    token_files,
    url_filter,
    vector_codes,
    warc,
)
from hydrolens.llm.common import byte_bpe_path
from hydrolens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token_files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, byte_bpe_path())
    return token_files.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_bpe_path(), scratch_path(spark, "packing"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op3_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_dropout.model_path()
    pieces = sentencepiece_dropout.encode(table(spark, sf_dir, "documents"), model)
    return sentencepiece_dropout.decode(pieces, model).select(
        "doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("bigint").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))
    return records.where("record_type IN ('response', 'revisit') OR error IS NOT NULL").select(
        warc.page_ids("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_ids("refers_to").alias("refers_to"), "error")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs, scratch_path(spark, "line_dedup")).select("doc_id", "text", "n_lines", "n_removed")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op7_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuzzy_hash.with_next(table(spark, sf_dir, "documents"))
    like = lambda other: fuzzy_hash.likeness(F.col("fingerprint"), F.col(other))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", like("edited_fingerprint").alias("near_edited"),
                       like("next_fingerprint").alias("near_next"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, scratch_path(spark, "minhash"), words=2).drop("text_hash", "first")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), scratch_path(spark, "vector_codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.word_bpe_path())


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_sentencepiece_dropout": op3_sentencepiece_dropout,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_html_density": op7_html_density,
    "op8_fuzzy_hash": op8_fuzzy_hash,
    "op9_minhash": op9_minhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_fill_middle": op13_fill_middle,
}

_STOP = ", ".join("'" + w + "'" for w in sorted(
    {v + end for w in quality.STOP_WORDS.split() for v in (w, w.capitalize()) for end in ("", ".", ",")}))

_TRIM = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def _nearest(book: str) -> str:
    """Each part's nearest entry: distance and entry in one number, so that the smallest is the lower index's."""
    return f"""SELECT rn, p.part, min(list_sum(list_transform(list_zip(p.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64
             + c.entry) AS near FROM p JOIN {book} c USING (part) GROUP BY rn, p.part"""


def _moved(book: str, near: str) -> str:
    """A codebook after a round: floors of the means of the parts that are nearest; unused entries stay."""
    return f"""SELECT b.part, b.entry, coalesce(n.w, b.w) AS w FROM {book} b LEFT JOIN (
        SELECT part, entry, list((s - ((s % k) + k) % k) // k ORDER BY pos) AS w FROM (
          SELECT part, near % 64 AS entry, pos, sum(x) AS s, count(*) AS k FROM (
            SELECT p.part, near, unnest(w) AS x, unnest(range(len(w))) AS pos FROM p JOIN {near} USING (rn, part))
          GROUP BY ALL) GROUP BY part, entry) n USING (part, entry)"""


SQL: dict[str, str] = {
    "op5_line_dedup": rf"""
WITH a AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM a),
t AS (SELECT doc_id, source, pos, {_TRIM} AS line FROM l WHERE {_TRIM} <> ''),
b AS (SELECT line FROM t GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
      AND (len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) >= {line_dedup.SHORT}
           OR count(*) * {line_dedup.SHARE} >= (SELECT count(*) FROM documents))),
h AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS place FROM t JOIN b USING (line)),
n AS (SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS chars FROM t GROUP BY doc_id),
g AS (SELECT doc_id, list(pos) AS gone FROM h JOIN t USING (doc_id, pos) JOIN n USING (doc_id) WHERE place > 1
      GROUP BY doc_id HAVING 5 * sum(length(line)) < 4 * any_value(chars))
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NOT NULL
    THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10))
    ELSE text END AS text
FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang NOT IN ('en', 'de', 'fr', 'es'), false) AS other FROM documents),
w AS (SELECT doc_id, t, other,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
      FROM d),
g AS (SELECT doc_id, i, ws[i:i + 4] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS rep FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        other OR 2 * length(regexp_replace(t, '[\P{{L}}\p{{Latin}}]+', '', 'g'))
          > length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS other,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop,
        len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1))::BIGINT AS n_upper
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words OR other)
   AND 100 * n_symbols <= 30 * n_words AND (100 * n_stop >= 2 * n_words OR n_words < 40 OR other)
   AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_upper <= 50 * n_words) AS kept
FROM b""",
    "op11_vector_codes": f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn, len(embedding) // 16 AS d,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS y FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, y[part * d + 1 : part * d + d] AS w FROM v, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, rn - 1 AS entry, w FROM p WHERE rn <= 64),
a0 AS MATERIALIZED ({_nearest("c0")}),
c1 AS MATERIALIZED ({_moved("c0", "a0")}),
a1 AS MATERIALIZED ({_nearest("c1")}),
c2 AS MATERIALIZED ({_moved("c1", "a1")}),
a2 AS ({_nearest("c2")}),
r AS (SELECT rn, string_agg(format('{{:02x}}', near % 64), '' ORDER BY part) AS code, sum(near // 64)::BIGINT AS error
      FROM a2 GROUP BY rn),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(w) AS x, unnest(range(len(w))) AS pos FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN r USING (rn), s""",
    "op13_fill_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
g AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
        array_to_string(list_slice(u, b + 1, n), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
}
