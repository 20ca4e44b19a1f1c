"""Queries on texts, terms, keys and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import chunking, filters, hashing, text, vectors
from siftwell.operators import lexical
from siftwell.session import table

PLAIN = lexical.TokenOptions(stem=False)
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS if "'" not in w)


def sql_tokens(column: str, stopwords: bool = True, least: int = 2) -> str:
    """SQL for the tokens of a column."""
    stop = f" AND x NOT IN ({_STOP})" if stopwords else ""
    return f"list_filter(list_transform(regexp_extract_all(replace(coalesce({column}, ''), '''', ''), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) BETWEEN {least} AND 40{stop})"


#: SQL for the 64-bit FNV-1a hash of a BLOB-able string expression, as an unsigned number.
def sql_fnv(expression: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({expression}))), lambda i: ('0x' || hex(encode({expression})[i + 1:i + 1]))::UHUGEINT)"
    return f"list_reduce(list_prepend({hashing.BASIS}::UHUGEINT, {octets}), lambda h, b: (xor(h, b) * {hashing.PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, each chunk once."""
    return table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])


def normalize_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalized_newlines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.octet_length(n).alias("bytes"), F.size(F.split(n, "\n", -1)).alias("lines"), F.md5(n).alias("digest")).filter("digest IS NOT NULL")


NORMALIZE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, strlen(t)::INTEGER AS bytes, len(string_split(t, chr(10)))::INTEGER AS lines, md5(t) AS digest FROM n
"""


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.token_rows(documents(spark, sf_dir), ["doc_id"], "text", lexical.TokenOptions(stem=False, drop_stopwords=False)).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


TOKENIZE_SQL = f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({sql_tokens('text', False)}) AS term FROM documents) GROUP BY term"


def doc_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"), text.token_estimate(F.coalesce("text", F.lit(""))).alias("estimate"))


TOKEN_COUNTS_SQL = f"SELECT doc_id, len({sql_tokens('text')})::INTEGER AS tokens, len(list_distinct({sql_tokens('text')}))::INTEGER AS distinct_tokens, ceil(strlen(coalesce(text, '')) / 4.0)::INTEGER AS estimate FROM documents"

_TF = f"WITH c AS (SELECT DISTINCT chunk_id, indexed_text FROM chunks), w AS (SELECT chunk_id, unnest({sql_tokens('indexed_text')}) AS term FROM c), tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL)"


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequencies(chunks(spark, sf_dir), ["chunk_id"], "indexed_text", PLAIN)


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequency(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(chunks(spark, sf_dir), "chunk_id", options=PLAIN)
    return index.terms.select("term", "df", F.round(index.idf(), 6).alias("idf"))


def porter_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its stem."""
    words = lexical.token_rows(documents(spark, sf_dir), ["doc_id"], "text", lexical.TokenOptions(stem=False, drop_stopwords=False, min_len=1))
    return text.stemmed_vocabulary(words)


def fnv_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "corpus_documents").select("corpus_id", "external_id", hashing.content_hash(F.col("title"), F.col("content"), F.col("metadata")).alias("hash"))
    return docs.distinct()


_FIELD = "octet_length(encode({0}))::VARCHAR || ':' || {0} || chr(10)"
_HASH_INPUT = (
    r"WITH d AS (SELECT corpus_id, external_id, coalesce(title, '') AS title, regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g') AS content, list_sort(map_entries(metadata)) AS m FROM corpus_documents), "
    + "h AS (SELECT DISTINCT corpus_id, external_id, " + _FIELD.format("title") + " || " + _FIELD.format("content")
    + " || coalesce(array_to_string(list_transform(m, lambda e: " + _FIELD.format("e.key") + " || octet_length(encode(coalesce(e.value, '')))::VARCHAR || ':' || coalesce(e.value, '') || chr(10)), ''), '') AS s FROM d) "
)
CONTENT_HASH_SQL = _HASH_INPUT + f"SELECT corpus_id, external_id, 'fnv1a64:' || lpad(lower(to_hex({sql_fnv('s')}::UBIGINT)), 16, '0') AS hash FROM h"


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all chunks as computed from document, lines and text, beside the stored ones."""
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", hashing.stable_chunk_key(F.col("document_id"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("computed_key"), F.col("chunk_key").alias("stored_key"))


_KEY_TEXT = r"document_id || chr(10) || start_line || ':' || end_line || chr(10) || regexp_replace(text, '\r\n?', chr(10), 'g')"
CHUNK_KEYS_SQL = f"WITH c AS (SELECT DISTINCT chunk_id, chunk_key, {_KEY_TEXT} AS s FROM chunks) SELECT chunk_id, 'chk_' || lpad(lower(to_hex({sql_fnv('s')}::UBIGINT)), 16, '0') AS computed_key, chunk_key AS stored_key FROM c"


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.embedded(chunks(spark, sf_dir).select("chunk_id", "text"), "text", vectors.HashEmbedder(16))
    return rows.select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


_WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))"
HASH_EMBEDDING_SQL = f"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), w AS (SELECT chunk_id, {_WORDS} AS w FROM c),
f AS (SELECT chunk_id, unnest(w) AS f, 1.0 AS s FROM w UNION ALL SELECT chunk_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.5 FROM w),
v AS (SELECT f, {sql_fnv('f')} AS h FROM (SELECT DISTINCT f FROM f)),
x AS (SELECT chunk_id, (h % 16)::INTEGER AS i, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -s ELSE s END)::DOUBLE AS x FROM f JOIN v USING (f) GROUP BY ALL),
n AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM x GROUP BY chunk_id),
g AS (SELECT n.chunk_id, i.i, coalesce(x.x, 0) / n.n AS x FROM n CROSS JOIN range(16) i(i) LEFT JOIN x ON x.chunk_id = n.chunk_id AND x.i = i.i WHERE n.n > 0)
SELECT chunk_id, list(round(x::FLOAT::DOUBLE, 5) ORDER BY i) AS embedding FROM g GROUP BY chunk_id
"""


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(text.normalized_newlines(F.col("text")), "\n", -1)).alias("line", "raw"))
    return lines.select("doc_id", "line", text.heading_level(F.col("raw")).alias("level"), text.heading_text(F.col("raw")).alias("heading")).filter("level > 0")


HEADINGS_SQL = r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line, unnest(l) AS raw FROM d)
SELECT doc_id, line, length(regexp_extract(raw, '^(#{1,6}) ', 1))::INTEGER AS level, regexp_replace(regexp_replace(raw, '^[# ]+', ''), '[# ]+$', '') AS heading FROM x WHERE regexp_matches(raw, '^#{1,6} ')
"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(documents(spark, sf_dir), "doc_id", "text")


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line, regexp_replace(unnest(l), '[ \t\x0B\f\r]+$', '') AS text FROM d)
SELECT * FROM x WHERE text <> ''
"""


def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "corpus_documents").select(F.concat_ws("/", "corpus_id", "external_id").alias("doc_key"), "content").dropDuplicates(["doc_key"])
    return chunking.chunk_documents(docs)


def chunk_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the service's sizes: target 320, at most 384 bytes, overlap 32."""
    docs = table(spark, sf_dir, "corpus_documents").select(F.concat_ws("/", "corpus_id", "external_id").alias("doc_key"), "content").dropDuplicates(["doc_key"])
    return chunking.chunk_documents(docs, chunking.SERVICE_OPTIONS)


def chunk_lines_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural chunker at one line a chunk, which SQL can state too."""
    docs = documents(spark, sf_dir).select("doc_id", "text").filter("text IS NOT NULL")
    o = chunking.ChunkOptions(max_lines=1, overlap_lines=0, heading_context=False, max_chars=1_000_000)
    rows = docs.select("doc_id", F.explode(chunking.chunks_of(F.col("text"), o)).alias("c"))
    return rows.select("doc_id", F.col("c.start_line").alias("line"), F.col("c.text").alias("text"))


def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", text.indexed_text(F.col("context"), F.col("text")).alias("computed"), F.col("indexed_text").alias("stored"))


INDEXED_SQL = "SELECT DISTINCT chunk_id, CASE WHEN coalesce(context, '') = '' THEN text ELSE context || chr(10) || text END AS computed, indexed_text AS stored FROM chunks"


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as JSON and read back."""
    docs = table(spark, sf_dir, "corpus_documents").select("corpus_id", "external_id", "metadata").filter("metadata IS NOT NULL")
    back = F.from_json(F.to_json("metadata"), "map<string,string>")
    entries = F.explode_outer(F.map_entries(back))
    return docs.select("corpus_id", "external_id", entries.alias("e")).select("corpus_id", "external_id", F.col("e.key").alias("key"), F.col("e.value").alias("value")).filter("value IS NOT NULL").distinct()


METADATA_SQL = "SELECT DISTINCT corpus_id, external_id, e.key AS key, e.value AS value FROM (SELECT corpus_id, external_id, unnest(map_entries(metadata)) AS e FROM corpus_documents) WHERE e.value IS NOT NULL"


def tag_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_documents").select("corpus_id", "external_id", filters.tag_fault(F.col("metadata")).alias("fault")).filter("fault IS NOT NULL").distinct()


TAG_SQL = """
WITH d AS (SELECT corpus_id, external_id, map_keys(metadata) AS k, map_values(metadata) AS v FROM corpus_documents WHERE metadata IS NOT NULL)
SELECT DISTINCT corpus_id, external_id, fault FROM (SELECT *, CASE WHEN len(k) > 64 THEN 'tags' WHEN len(list_filter(k, lambda x: x = '' OR strlen(x) > 128)) > 0 THEN 'key'
  WHEN len(list_filter(v, lambda x: x IS NULL OR strlen(x) > 4096)) > 0 THEN 'value' WHEN coalesce(list_sum(list_transform(list_concat(k, v), lambda x: strlen(x))), 0) > 65536 THEN 'total' END AS fault FROM d) WHERE fault IS NOT NULL
"""


def utf8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes, whole and with a byte that no UTF-8 text has before and after: checked and repaired."""
    raw = F.encode(F.col("text"), "utf-8")
    broken = F.concat(F.unhex(F.lit("FF")), raw, F.unhex(F.lit("C3")))
    as_text = lambda b: b.cast("string")
    return documents(spark, sf_dir).filter("text IS NOT NULL").select(
        "doc_id", F.is_valid_utf8(as_text(raw)).alias("valid"), F.is_valid_utf8(as_text(broken)).alias("broken_valid"), F.octet_length(text.valid_text(as_text(broken))).alias("repaired_bytes"), (text.valid_text(as_text(raw)) == F.col("text")).alias("unchanged")
    )


UTF8_SQL = "SELECT doc_id, true AS valid, false AS broken_valid, (strlen(text) + 6)::INTEGER AS repaired_bytes, true AS unchanged FROM documents WHERE text IS NOT NULL"


def crc32_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of the texts' bytes, as a log's records carry it."""
    return documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.crc32(F.encode(F.col("text"), "utf-8")).alias("crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_newlines, tokenize_terms, doc_token_counts, term_frequency, document_frequency, idf_table, porter_stems, fnv_content_hash, chunk_keys, hash_embedding, heading_levels,
        line_chunks, chunk_structural, chunk_service, chunk_lines_simple, indexed_texts, metadata_json, tag_faults, utf8_checks, crc32_checks,
    )
}
ORACLE = {
    "normalize_newlines": NORMALIZE_SQL,
    "tokenize_terms": TOKENIZE_SQL,
    "doc_token_counts": TOKEN_COUNTS_SQL,
    "term_frequency": _TF + " SELECT chunk_id, term, tf FROM tf",
    "document_frequency": _TF + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
    "idf_table": _TF + ", n AS (SELECT count(*) AS n FROM c) SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf CROSS JOIN n GROUP BY term, n",
    "fnv_content_hash": CONTENT_HASH_SQL,
    "chunk_keys": CHUNK_KEYS_SQL,
    "hash_embedding": HASH_EMBEDDING_SQL,
    "heading_levels": HEADINGS_SQL,
    "line_chunks": LINES_SQL,
    "chunk_lines_simple": LINES_SQL,
    "indexed_texts": INDEXED_SQL,
    "metadata_json": METADATA_SQL,
    "tag_faults": TAG_SQL,
    "utf8_checks": UTF8_SQL,
}
