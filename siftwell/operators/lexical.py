"""Inverted index tables and BM25 retrieval for batches of queries.

The index is one row per chunk with its distinct terms and their frequencies, counted where the text is, and a table of
document frequencies. There are two ways to search it, with the same results; which is taken depends on how many postings
the queries' terms have, counted before:

- few (single questions): postings lie in directories by a hash of the term, so only those of the terms are read. They are joined with
  the broadcast terms where they are, and what is shuffled are scores;
- many (batches of long queries, whose terms are in most chunks): blocks of queries go to the chunks, each task sums its chunks' scores in
  matrices and sends k rows per query. Postings are not shuffled at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.blocks import CELLS, Best, key_array
from siftwell.session import fresh_path, materialize

K1, B = 1.2, 0.75
#: A frequency table of up to so many terms is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 200_000
#: So many query terms make a block that is sent to the chunks; so many are broadcast to the postings (some 50 bytes each).
BLOCK_TERMS, BROADCAST_QUERY_TERMS = 1_000_000, 100_000
#: Directories of postings, by a hash of the term.
BUCKETS = 64


@dataclass(frozen=True)
class TokenOptions:
    lowercase: bool = True
    drop_stopwords: bool = True
    stem: bool = True
    min_len: int = 2
    max_len: int = 40


def counted(df: DataFrame, keys: list[str], text: str, o: TokenOptions = TokenOptions()) -> DataFrame:
    """(keys, terms, tfs, token_count): the distinct terms of each row with their frequencies, without a shuffle. ``min_len`` holds for the stem.

    Tokens are cut in the JVM; counting and stemming see each distinct word of a batch once.
    """
    words = T.tokens(F.col(text), lowercase=o.lowercase, drop_stopwords=o.drop_stopwords, min_len=1 if o.stem else o.min_len, max_len=o.max_len)
    rows = df.select(*keys, words.alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            column = b.columns[-1]
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            coded = column.flatten().dictionary_encode()
            words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lengths)
            if o.stem:
                if len(memo) > 1_000_000:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = T.stem(w)
                stems = [memo[w] for w in words]
                words = list(dict.fromkeys(s for s in stems if len(s) >= o.min_len))
                number = {w: i for i, w in enumerate(words)}
                code = np.array([number.get(s, -1) for s in stems], np.int64)[code] if len(code) else code
                row, code = row[code >= 0], code[code >= 0]
            pair, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
            row, code = pair // max(1, len(words)), pair % max(1, len(words))
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array(words, pa.string()).take(pa.array(code)))
            tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            total = pa.array(np.bincount(row, tf, b.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], terms, tfs, total], [*b.schema.names[:-1], "terms", "tfs", "token_count"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kept}, terms array<string>, tfs array<int>, token_count long")


def token_rows(df: DataFrame, keys: list[str], text: str, o: TokenOptions = TokenOptions()) -> DataFrame:
    """(keys, term): one row per token."""
    return term_frequencies(df, keys, text, o).select(*keys, "term", F.explode(F.array_repeat(F.lit(0), F.col("tf").cast("int"))).alias("_i")).drop("_i")


def term_frequencies(df: DataFrame, keys: list[str], text: str, o: TokenOptions = TokenOptions()) -> DataFrame:
    """(keys, term, tf), of rows with distinct keys."""
    return counted(df, keys, text, o).select(*keys, F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select(*keys, F.col("_t.terms").alias("term"), F.col("_t.tfs").cast("long").alias("tf"))


@dataclass
class LexicalIndex:
    chunks: DataFrame  # chunk_key, metadata if given, terms, tfs, token_count
    terms: DataFrame  # term, df
    count: int
    average: float
    postings: int
    options: TokenOptions
    small_terms: bool
    _inverted: list[DataFrame] = field(default_factory=list)

    def idf(self) -> Column:
        return F.log(1 + (F.lit(float(self.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def weight(self) -> Column:
        """What a posting (tf, token_count) gives per unit of a query term's weight."""
        tf = F.col("tf")
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("token_count") / max(self.average, 1.0)))

    def inverted(self) -> DataFrame:
        """(bucket, term, chunk_key, weight), written by bucket of the term when it is first asked for. Large buckets are split by size, so a hot term is no task of its own."""
        if not self._inverted:
            spark = self.chunks.sparkSession
            rows = self.chunks.select("chunk_key", "token_count", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("chunk_key", "token_count", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf"))
            rows = rows.select(bucket().alias("bucket"), "term", "chunk_key", self.weight().alias("weight"))
            path = fresh_path(spark, "postings")
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
            self._inverted.append(spark.read.schema(rows.schema).parquet(path))
        return self._inverted[0]

    def write(self, path: str) -> None:
        """Keep the index under a path; ``read`` opens it. The note of its figures comes last, so a torn write is no index."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.inverted().write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        figures = json.dumps({"count": self.count, "average": self.average, "postings": self.postings, "options": self.options.__dict__, "small_terms": self.small_terms})
        spark.createDataFrame([(figures,)], "figures string").coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        f = json.loads(spark.read.parquet(f"{path}/figures").first()[0])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return LexicalIndex(read("chunks"), read("terms"), f["count"], f["average"], f["postings"], TokenOptions(**f["options"]), f["small_terms"], [read("postings")])


def bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def build(chunks: DataFrame, key: str = "chunk_key", text: str = "indexed_text", metadata: str | None = None, options: TokenOptions = TokenOptions()) -> LexicalIndex:
    """Index a table of chunks with distinct keys. Chunks without tokens count in number and average length."""
    c = chunks.select(F.col(key).alias("chunk_key"), F.col(text).alias("_text"), *([F.col(metadata).alias("metadata")] if metadata else []))
    rows = materialize(counted(c, ["chunk_key", *(["metadata"] if metadata else [])], "_text", options), "chunks")
    stats = rows.agg(F.count("*").alias("n"), F.avg("token_count").alias("average"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    terms = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    return LexicalIndex(rows, terms, stats["n"], float(stats["average"] or 1.0), stats["postings"], options, terms.count() <= BROADCAST_TERMS)


def query_terms(queries: DataFrame, query: str, text: str, options: TokenOptions) -> DataFrame:
    """(query_id, term, qtf): terms of a query are a multiset."""
    q = queries.select(F.col(query).alias("query_id"), F.col(text).alias("_text"))
    return term_frequencies(q, ["query_id"], "_text", options).withColumnRenamed("tf", "qtf")


def weighted(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """(query_id, term, qweight, df) of the query terms that the index has, written once."""
    df = F.broadcast(index.terms) if index.small_terms else index.terms
    return materialize(terms.join(df, "term").select("query_id", "term", (F.col("qtf") * index.idf()).alias("qweight"), "df"), "query-terms")


def scores(index: LexicalIndex, q: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(query_id, chunk_key, score) of every chunk that shares a term with a query, from the postings of the terms of ``weighted``.

    Scores are rounded to 9 places, so equal ones are equal in whatever order they were summed. ``allowed`` restricts the chunks by their metadata before any ranking; document frequencies stay those of the whole index.
    """
    p = index.inverted()
    wanted = q.select("query_id", "term", "qweight", bucket().alias("bucket"))
    touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
    p = p.filter(F.col("bucket").isin(touched))
    small = q.count() <= BROADCAST_QUERY_TERMS
    joined = p.join(F.broadcast(wanted) if small else wanted, ["bucket", "term"])
    if allowed is not None:
        joined = joined.join(index.chunks.filter(allowed).select("chunk_key"), "chunk_key", "left_semi")
    return joined.groupBy("query_id", "chunk_key").agg(F.round(F.sum(F.col("qweight") * F.col("weight")), 9).alias("score"))


@dataclass
class _Block:
    """Queries of a block: their ids, the distinct terms, and for groups of queries the (term, query, weight) triples by term. Its size is that of the triples, however many groups and terms there are."""

    ids: pa.Array
    terms: pa.Array
    groups: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # first, end, terms, queries, weights


def _block(q: pa.Table, rows: int) -> _Block:
    coded = q.column("query_id").combine_chunks().dictionary_encode()
    words = q.column("term").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded, words = coded.unify_dictionaries().chunk(0), words.unify_dictionaries().chunk(0)
    query, term, weight = coded.indices.to_numpy(), words.indices.to_numpy(), q.column("qweight").to_numpy()
    step, groups = max(1, CELLS // rows), []
    order = np.lexsort((term, query // step))
    query, term, weight = query[order], term[order], weight[order]
    group = query // step
    for first in range(0, len(coded.dictionary), step):
        own = slice(*np.searchsorted(group, [first // step, first // step + 1]))
        groups.append((first, min(len(coded.dictionary), first + step), term[own].astype(np.int32), (query[own] - first).astype(np.int32), weight[own]))
    return _Block(coded.dictionary, words.dictionary, groups)


def _sums(b: pa.RecordBatch, block: _Block, average: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores of its group against the rows of the batch, not yet rounded), a group at a time."""
    n = b.num_rows
    lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
    row = np.repeat(np.arange(n), lengths)
    code = pc.fill_null(pc.index_in(b.column(1).flatten(), value_set=block.terms), -1).to_numpy()
    tf, size = b.column(2).flatten().to_numpy().astype(np.float64), b.column(3).to_numpy()
    known = code >= 0
    row, code, tf = row[known], code[known], tf[known]
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / max(average, 1.0)))
    for first, end, term, query, qweight in block.groups:
        starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(block.terms))))
        pairs = starts[code + 1] - starts[code]
        own = np.flatnonzero(pairs)
        total = np.zeros((end - first) * n)
        cuts = np.searchsorted(np.cumsum(pairs[own]), np.arange(0, pairs.sum() + CELLS, CELLS))
        for i, j in zip(cuts, [*cuts[1:], len(own)], strict=True):
            if i < j:
                some = own[i:j]
                m = pairs[some]
                at = np.repeat(starts[code[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                total += np.bincount(query[at].astype(np.int64) * n + np.repeat(row[some], m), qweight[at] * np.repeat(weight[some], m), len(total))
        yield first, total.reshape(end - first, n)


def best_by_blocks(index: LexicalIndex, q: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """(query_id, chunk_key, score): the k best chunks per query and task, from the terms of ``weighted`` in blocks of queries."""
    spark = q.sparkSession
    chunks = index.chunks if allowed is None else index.chunks.filter(allowed)
    chunks = chunks.select("chunk_key", "terms", "tfs", "token_count")
    key_type = chunks.schema["chunk_key"].dataType
    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_key {key_type.simpleString()}, score double"
    n, average, found = q.count(), index.average, None
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    blocks = max(1, -(-n // BLOCK_TERMS))
    for i in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        got = part.select("query_id", "term", "qweight").toArrow()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(_block(got, rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, best = shared.value, Best(k)
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    b = b.take(pa.array(np.argsort(key_array(b.column(0)), kind="stable")))
                    keys = key_array(b.column(0))
                    for first, s in _sums(b, block, average):
                        best.add_matrix(first, keys, s, 9)
            yield from best.batches(block.ids, key_type, ["query_id", "chunk_key", "score"])

        one = chunks.mapInArrow(run, out)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], out)


def top(scored: DataFrame, k: int, key: str = "chunk_key", group: str = "query_id", score: str = "score") -> DataFrame:
    """The k best per query by (score descending, key ascending), with ``rank`` from 1; the limit is applied before the shuffle too."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_terms(index: LexicalIndex, terms: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """(query_id, chunk_key, score, rank) for (query_id, term, qtf). The way with less work is taken: the terms' postings, if they are under a quarter of all, else all chunks."""
    q = weighted(index, terms)
    met = q.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return top(scores(index, q, allowed) if met * 4 < index.postings else best_by_blocks(index, q, k, allowed), k)


def search(index: LexicalIndex, queries: DataFrame, query: str, text: str, k: int, allowed: Column | None = None) -> DataFrame:
    """(query_id, chunk_key, score, rank)."""
    return search_terms(index, query_terms(queries, query, text, index.options), k, allowed)


def coverage(index: LexicalIndex, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_key, coverage): the share of a query's distinct terms that a candidate chunk has. Queries without terms have no rows."""
    of = terms.groupBy(F.col("query_id").alias("_q")).agg(F.collect_set("term").alias("_wanted"))
    j = candidates.select("query_id", "chunk_key").join(index.chunks.select("chunk_key", F.col("terms").alias("_terms")), "chunk_key").join(of, F.col("query_id") == F.col("_q"))
    return j.select("query_id", "chunk_key", (F.size(F.array_intersect("_wanted", "_terms")) / F.size("_wanted")).alias("coverage"))


def score_chunks(index: LexicalIndex, terms: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, chunk_key, score) of given (query_id, chunk_key) pairs; 0 without a common term."""
    q = weighted(index, terms)
    own = keys.select("query_id", "chunk_key").join(index.chunks.select("chunk_key", "terms", "tfs", "token_count"), "chunk_key")
    got = own.select("query_id", "chunk_key", "token_count", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("query_id", "chunk_key", "token_count", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf")).join(q, ["query_id", "term"])
    sums = got.groupBy("query_id", "chunk_key").agg(F.round(F.sum(F.col("qweight") * index.weight()), 9).alias("_s"))
    return keys.join(sums, ["query_id", "chunk_key"], "left").select("query_id", "chunk_key", F.coalesce("_s", F.lit(0.0)).alias("score"))
