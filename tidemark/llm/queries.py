"""The thin ``opN_*`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpetree, linequality, minhash, packing, revisit, rlz, sharding, tokenframes, toxicity, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, lambda vec_id: vec_id % 20 == 0, k=20)


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels)).drop("text")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records of the pages: a full response each, then a conditional request that gets a 304.

    Every seventh page has changed its entity tag since, and every eleventh sends no tag but a date.
    """
    page, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag, changed = F.md5(html.cast("binary")), F.concat(F.lit("day "), page % 28)
    empty = F.lit(None).cast("string")
    tagged = page % 11 != 0
    full = F.struct(
        (page * 2).alias("record_id"), page.alias("time"), F.lit(200).alias("status"), F.when(tagged, tag).alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.octet_length(html).cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag).alias("headers"),
    )
    sent = F.when(page % 7 == 0, F.concat(tag, F.lit("-new"))).otherwise(F.concat(F.lit("W/"), tag))
    again = F.struct(
        (page * 2 + 1).alias("record_id"), (page + 50).alias("time"), F.lit(304).alias("status"), F.when(tagged, sent).alias("etag"), F.when(page % 13 != 0, changed).otherwise(empty).alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("day "), page % 31)).alias("headers"),
    )
    return pages.select("url", F.explode(F.array(full, again)).alias("r")).select("url", "r.*")


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisit.resolve(captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.withColumn("headers", F.array_join(lines, "; "))


def op5_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpetree.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, share=80)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linequality.clean_lines(docs).drop("text", "clean_text")


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokenframes.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenframes.read_token_files(manifest)


def op9_rlz_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, with_text=False)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.xxhash64("text").alias("group"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.assign_shards(docs, group="group", shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_va_file_top_k, op3_ordinal_toxicity, op4_revisit_resolution, op5_tree_concatenation, op6_minhash_components, op7_line_quality, op8_token_frames, op9_rlz_repeats, op10_sampled_splitters)
}

_CANONICAL = r"""
bare1 AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') AS b FROM pages),
bare2 AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b,
    '([?&])(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS b FROM bare1),
canon AS (SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1), '/+$', '') AS u FROM bare2)
"""

OP4_SQL = f"""
WITH {_CANONICAL},
asked AS (
  SELECT a.page_id, a.u, max(b.page_id) AS r FROM canon a
  LEFT JOIN canon b ON a.u = b.u AND b.page_id < a.page_id + 50 GROUP BY 1, 2),
pairs AS (
  SELECT a.page_id * 2 + 1 AS record_id, a.u AS canonical_url, r * 2 AS response_id, md5(p.html) AS r_tag, octet_length(encode(p.html)) AS n,
    a.page_id % 31 AS day,
    CASE WHEN r IS NULL THEN 'missing'
      WHEN a.page_id % 11 != 0 AND r % 11 != 0 THEN
        CASE WHEN md5(q.html) || (CASE WHEN a.page_id % 7 = 0 THEN '-new' ELSE '' END) = md5(p.html) THEN 'resolved' ELSE 'mismatch' END
      WHEN a.page_id % 13 != 0 THEN CASE WHEN a.page_id % 28 = r % 28 THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unchecked' END AS resolution
  FROM asked a LEFT JOIN canon p ON p.page_id = r JOIN canon q ON q.page_id = a.page_id)
SELECT record_id, canonical_url, response_id, resolution,
  CASE WHEN resolution = 'resolved'
    THEN 'cache-control: max-age=120; content-length: ' || n || '; content-type: text/html; date: day ' || day || '; etag: ' || r_tag
    ELSE 'cache-control: max-age=120; content-length: 0; date: day ' || day END AS headers
FROM pairs
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM w, unnest(range(1, greatest(2, len(ws) - 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.other),
least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP7_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws FROM documents),
triples AS (SELECT doc_id, i, ws[i : i + 2] AS t FROM w, unnest(range(1, greatest(1, len(ws) - 1))) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM triples) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS k(j) GROUP BY doc_id),
lines AS (SELECT doc_id, line, {_WORDS.format("line")} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)),
judged AS (SELECT doc_id, line, len(ws) AS n,
    4 * len(regexp_extract_all(line, '[|»›•·→]')) >= len(ws)
    OR len(regexp_extract_all(line, '[#*$%&<>!]')) > 0.3::DOUBLE * len(ws) + 1
    OR (len(ws) < 8 AND NOT regexp_matches(line, '[.!?:;…。！？”’»]["'')\]}}*_]*[\x20\x09-\x0D]*$'))
    OR (len(ws) <= 30 AND regexp_matches(line, 'all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept cookies|click here|sign up|log ?in\b|subscribe (?:now|to)|javascript|powered by|lorem ipsum|back to top|skip to content|share (?:this|on)', 'i')) AS bad
  FROM lines WHERE len(ws) > 0),
by_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (bad), 0) AS lost FROM judged GROUP BY doc_id),
figures AS (SELECT w.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(removed, 0) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS n_words_removed
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN by_doc USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_removed <= 0.5::DOUBLE * n_words AS kept FROM figures
"""

OP9_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS t FROM w, unnest(range(1, greatest(1, len(ws) - 33))) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM twice, range(0, 35) AS k(j)),
stays AS (SELECT p.doc_id, p.i, p.word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM stays GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

#: The others need a tokenizer, a fitted model or a sample; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_va_file_top_k": OP2_SQL, "op4_revisit_resolution": OP4_SQL, "op6_minhash_components": OP6_SQL, "op7_line_quality": OP7_SQL, "op9_rlz_repeats": OP9_SQL,
}
