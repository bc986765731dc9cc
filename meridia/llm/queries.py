"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprints, langid, merkle, neardup, quality, sharding, tiff, token_files, toolcalls, vectorcodes, warc
from .textkit import shared_folder

#: Path of the tokenizer file; it stays where the public package keeps it.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Appended to each document in token files.
END_ID = 1
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, written and read back."""
    folder = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), WORD_BPE, folder, END_ID)
    return token_files.read(spark, folder, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, its score, and whether it is rejected as too far from all languages."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", F.coalesce(~langid.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat turns as calls and results: linked, ordered by dependency, validated and serialised."""
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TURN_TOOLS)


#: What op3_tool_calls gives: DuckDB has its own JSON functions.
OP3_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, CAST(turn AS VARCHAR) AS call_id, CASE role WHEN 'system' THEN 'configure' ELSE 'ask' END AS name, text
  FROM conversations WHERE role IN ('system', 'user') AND turn IS NOT NULL AND conv_id IS NOT NULL
), results AS (
  SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, min(text) AS content, count(*) AS n
  FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1, 2
), checked AS (
  SELECT c.*, r.content, r.n, list_filter([
    CASE WHEN text IS NULL THEN 'text: missing' END,
    CASE WHEN name = 'ask' AND length(text) > 400 THEN 'text: maxLength' END,
    CASE WHEN length(text) < 1 THEN 'text: minLength' END,
    CASE WHEN name = 'configure' AND turn > 0 THEN 'turn: maximum' END,
    CASE WHEN turn < 0 THEN 'turn: minimum' END], lambda x: x IS NOT NULL) AS found
  FROM calls c LEFT JOIN results r USING (conv_id, call_id)
), known AS (SELECT DISTINCT conv_id, turn, call_id FROM calls),
needs AS (
  SELECT DISTINCT c.conv_id, c.call_id, k.call_id AS parent FROM calls c JOIN known k ON k.conv_id = c.conv_id AND c.name = 'ask' AND c.turn >= 1 AND k.turn = CASE c.turn WHEN 1 THEN 0 ELSE c.turn - 2 END
), chains AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM known k WHERE NOT EXISTS (SELECT 1 FROM needs n WHERE n.conv_id = k.conv_id AND n.call_id = k.call_id)
  UNION SELECT n.conv_id, n.call_id, c.level + 1 FROM chains c JOIN needs n ON n.conv_id = c.conv_id AND n.parent = c.call_id
), levels AS (SELECT conv_id, call_id, max(level) AS level FROM chains GROUP BY 1, 2)
SELECT conv_id, call_id, level, turn AS seq, name, len(found) = 0 AS valid, coalesce(array_to_string(found, '; '), '') AS errors, n IS NOT NULL AS linked,
  '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || turn || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS record
FROM checked JOIN levels USING (conv_id, call_id)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(~quality.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, with digests of both."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back as chunks; the row of the last chunk of each."""
    folder = shared_folder(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages")), folder)
    chunks = warc.read(spark, folder, with_payload=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS p, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY p) END AS first FROM r)
SELECT page_id, n AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    rows = sharding.records(table(spark, sf_dir, "documents"))
    return sharding.assign_records(rows, sharding.plan_records(rows, SHARDS))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each item of the benchmark that leaks into it."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, over shingles of 2 words."""
    return neardup.find(table(spark, sf_dir, "documents"), words=2)


#: Whole texts and all pairs that share a shingle; reach over links by recursion.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT s.doc_id, sh, n FROM s JOIN n ON n.doc_id = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS far FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.far),
c AS (SELECT id, min(far) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.id = w.doc_id
"""


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as TIFF files of all compressions and back, with digests and features."""
    return tiff.round_trip(table(spark, sf_dir, "documents"), compression=None)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, their errors, the errors of their labels, and the digest of all codebooks."""
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    found = vectorcodes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """What op11_vector_codes gives: plain rounds over all entries, for vectors of one length that 8 divides."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    for k in range(rounds + 1):
        out += f""",
a{k} AS (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min(struct_pack(d := d, e := entry)) AS best FROM (SELECT vec_id, label, p.part, x, entry, {distance} AS d FROM p JOIN c{k} b ON b.part = p.part) GROUP BY vec_id, part)"""
        if k < rounds:
            out += f""",
m{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, best.e AS entry, i, sum(x[i + 1]) AS s, count(*) AS n, CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) AS m FROM a{k}, range(len(x)) r(i) GROUP BY part, best.e, i) GROUP BY part, entry),
c{k + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM c{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return out + f""",
e AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with the proof of each held against its tampered text."""
    return merkle.manifest_of_documents(table(spark, sf_dir, "documents"))


#: What op12_merkle gives for ids that don't repeat: levels by recursion; the CRC-32 of an id's digits bit by bit.
OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM d
), trees AS (
  SELECT source, 0 AS level, i, n, h FROM leaves
  UNION ALL SELECT source, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY source, level, i // 3
), subroots AS (SELECT source, h, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3
), nodes AS (  -- every node of both kinds of trees; the trees over subroots go on from the sources' heights
  SELECT coalesce('s' || source, 'null') AS tree, level, i, n, h FROM trees WHERE n > 1 UNION ALL SELECT 'top', level, i, n, h FROM top WHERE n > 1
), runs AS (SELECT tree, level, i // 3 AS run, list(struct_pack(i := i, h := h) ORDER BY i) AS members FROM nodes GROUP BY tree, level, i // 3),
way AS (
  SELECT l.doc_id, l.h AS leaf, s.h AS subroot, coalesce(l.tampered, l.h) AS folded, '' AS proof, coalesce('s' || l.source, 'null') AS tree, 0 AS level, l.i, s.height, s.i AS place FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  UNION ALL
  SELECT doc_id, leaf, subroot,
    CASE WHEN members IS NULL THEN folded ELSE sha256(array_to_string(list_transform(members, lambda m: CASE WHEN m.i = w.i THEN folded ELSE m.h END), '')) END,
    CASE WHEN members IS NULL THEN proof ELSE proof || coalesce(array_to_string(list_transform(list_filter(members, lambda m: m.i <> w.i), lambda m: m.h), ''), '') END,
    CASE WHEN w.tree <> 'top' AND w.level = height THEN 'top' ELSE w.tree END, CASE WHEN w.tree <> 'top' AND w.level = height THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.tree <> 'top' AND w.level = height THEN place ELSE w.i // 3 END, height, place
  FROM way w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.i // 3
  WHERE w.tree <> 'top' OR r.run IS NOT NULL
), done AS (SELECT * FROM way w WHERE tree = 'top' AND level = (SELECT max(level) FROM top))
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM top WHERE n = 1) AS verified FROM done
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next document's."""
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_language_id, op3_tool_calls, op4_quality, op5_bpe, op6_warc, op7_sharding, op8_decontamination, op9_near_duplicates, op10_tiff, op11_vector_codes, op12_merkle, op13_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_tool_calls": OP3_SQL, "op6_warc": OP6_SQL, "op9_near_duplicates": OP9_SQL, "op11_vector_codes": _op11_sql(), "op12_merkle": OP12_SQL}
