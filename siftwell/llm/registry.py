"""Queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import abuse, mixing, neighbours, packing, rank_fusion, splitting, term_weights
from siftwell.operators import dense
from siftwell.session import materialize, table

CAPACITY = 2048


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' most characteristic terms: found by the operator's weights, then the exact measure decides among those near the top."""
    w = materialize(term_weights.term_weights(table(spark, sf_dir, "postings"), table(spark, sf_dir, "chunks")), "weights")
    near = materialize(term_weights.near_the_top(w), "near")
    value = F.round(F.col("tf") * F.log(F.col("records") / F.col("df")), 6)
    top = near.select("record", "term", "tf", "df", value.alias("value"))
    best = top.groupBy(F.col("record").alias("_r")).agg(F.max("value").alias("_best"))
    j = top.filter("tf >= 3 AND df >= 2").join(best, (F.col("record") == F.col("_r")) & (F.col("value") == F.col("_best")))
    return j.select(F.col("record").alias("doc"), "term")


_P2_BASE = """
WITH p AS (SELECT DISTINCT term, doc, tf FROM postings WHERE term IS NOT NULL AND tf > 0),
t AS (SELECT doc, lower(trim(term, ' ')) AS term, sum(tf)::BIGINT AS tf FROM p WHERE doc IN (SELECT chunk_id FROM chunks) GROUP BY ALL),
n AS (SELECT count(DISTINCT doc) AS n FROM t),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
"""
P2_SQL = (
    _P2_BASE
    + """v AS (SELECT t.doc, t.term, t.tf, d.df, round(t.tf * ln(n.n / d.df), 6) AS value FROM t JOIN d USING (term) CROSS JOIN n),
r AS (SELECT *, max(value) OVER (PARTITION BY doc) AS best FROM v)
SELECT doc, term FROM r WHERE value = best AND tf >= 3 AND df >= 2
"""
)


def p2_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every chunk with its BM25 weight."""
    w = term_weights.term_weights(table(spark, sf_dir, "postings"), table(spark, sf_dir, "chunks"))
    return w.select(F.col("record").alias("doc"), "term", "tf", "df", F.round("weight", 5).alias("weight"))


P2_WEIGHTS_SQL = (
    _P2_BASE
    + """l AS (SELECT doc, sum(tf)::BIGINT AS len FROM t GROUP BY doc),
a AS (SELECT avg(len) AS avg_len FROM l)
SELECT t.doc, t.term, t.tf, d.df, round(ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / a.avg_len)), 5) AS weight
FROM t JOIN d USING (term) JOIN l USING (doc) CROSS JOIN n CROSS JOIN a
"""
)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "corpus_documents"), ["corpus_id", "external_id"], "content", 1600, 2)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of non-blank lines over the limit, as the splitter met and cut them."""
    runs = _pieces(spark, sf_dir).filter(F.size("long_runs") > 0).select("corpus_id", "external_id", F.explode("long_runs").alias("r"))
    return runs.select("corpus_id", "external_id", "r.start_line", "r.end_line").distinct()


P4_SQL = r"""
WITH d AS (SELECT DISTINCT corpus_id, external_id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM corpus_documents WHERE content IS NOT NULL),
big AS (SELECT * FROM d WHERE strlen(c) > 1600),
l AS (SELECT corpus_id, external_id, c, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS i FROM big),
g AS (SELECT *, i - row_number() OVER (PARTITION BY corpus_id, external_id, c ORDER BY i) AS g FROM l WHERE trim(line, ' ' || chr(9)) <> '')
SELECT DISTINCT corpus_id, external_id, start_line, end_line FROM (
  SELECT corpus_id, external_id, min(i)::INTEGER AS start_line, max(i)::INTEGER AS end_line, sum(strlen(line)) + count(*) - 1 AS bytes FROM g GROUP BY corpus_id, external_id, c, g) WHERE bytes > 1600
"""


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized documents."""
    return _pieces(spark, sf_dir).select("corpus_id", "external_id", "ordinal", "level", "start_line", "end_line", "repeated_lines", F.octet_length("text").alias("bytes"), "text")


def p4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new parts of each document's pieces, put together again: the digest of the text, and whether every piece keeps the limit and its lines."""
    pieces = _pieces(spark, sf_dir)
    raw = F.encode("text", "utf-8")
    own = F.concat(raw, F.repeat(F.lit("\n"), (F.col("end_byte") - F.col("start_byte") - F.octet_length("text")).cast("int")).cast("binary"))
    new = F.substring(own, (F.col("new_byte") - F.col("start_byte") + 1).cast("int"), F.lit(2_147_483_647))
    lines = F.size(F.split("text", "\n", -1)) == F.col("end_line") - F.col("start_line") + 1
    rows = pieces.select("corpus_id", "external_id", "ordinal", new.alias("new"), ((F.octet_length("text") <= 1600) & lines).alias("ok"))
    whole = rows.groupBy("corpus_id", "external_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "new"))).alias("parts"), F.min("ok").alias("within"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda t, x: F.concat(t, x["new"]))
    return whole.select("corpus_id", "external_id", F.md5(joined).alias("digest"), "within")


P4_ROUND_TRIP_SQL = r"""
WITH d AS (SELECT corpus_id, external_id, max(content) AS c FROM corpus_documents WHERE content IS NOT NULL GROUP BY ALL),
n AS (SELECT corpus_id, external_id, replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM d)
SELECT corpus_id, external_id, md5(c) AS digest, true AS within FROM n WHERE strlen(c) > 1600
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose embeddings have a cosine of at least 0.9."""
    pairs, members = neighbours.similar_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", 64, 0.9)
    pairs = materialize(pairs, "similar")
    return neighbours.expanded_pairs(pairs, members).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


P5_SQL = """
WITH u AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64),
v AS (SELECT chunk_id, e, sqrt(list_dot_product(e, e)) AS n FROM u WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id AND a.n > 0 AND b.n > 0
WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
"""


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of every chunk."""
    return neighbours.nearest(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", 64, 10).withColumnRenamed("id", "chunk_id")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the chunks whose id is divisible by 20 against an exact search over all: whether nine tenths of the places are as good."""
    chunks = table(spark, sf_dir, "chunks")
    v = materialize(dense.usable_vectors(chunks, "chunk_id", "embedding", 64, rescale=True), "vectors")
    exact = dense.batch_search(v, v.filter("key % 20 = 0").select(F.col("key").alias("query_id"), "vector"), 11, 64).filter("query_id <> key")
    # the chunk itself is among its eleven nearest, whatever its copies are called
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    best = exact.withColumn("place", place).filter("place <= 10").select("query_id", "place", "score")
    found = p5_nearest(spark, sf_dir).filter("chunk_id % 20 = 0")
    j = best.join(found, (F.col("query_id") == F.col("chunk_id")) & (F.col("place") == F.col("rank")), "left")
    good = F.coalesce(F.col("similarity") >= F.col("score") - 1e-3, F.lit(False))
    return j.agg(F.countDistinct("query_id").alias("queries"), (F.avg(good.cast("double")) >= 0.9).alias("reached"))


P5_RECALL_SQL = """
WITH u AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND chunk_id % 20 = 0)
SELECT count(DISTINCT chunk_id) AS queries, true AS reached FROM u WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each query by reciprocal places, looked up among the items whose Borda points let them be there."""
    ranks = materialize(rank_fusion.list_ranks(table(spark, sf_dir, "ranked_lists")), "ranks")
    fused = materialize(rank_fusion.fuse(ranks), "fused")
    return rank_fusion.first_by_reciprocal(ranks, fused, 3).select("query_id", F.col("item").alias("chunk_id"))


_P7_BASE = """
WITH l AS (SELECT query_id, list_no, weight::DOUBLE AS weight, lower(trim(score_type)) AS st, hits FROM ranked_lists WHERE weight IS NOT NULL AND isfinite(weight) AND weight >= 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY weight DESC, st DESC) AS k FROM l) WHERE k = 1),
h AS (SELECT query_id, list_no, weight, st, unnest(hits) AS x FROM o),
s AS (SELECT query_id, list_no, weight, x.chunk AS chunk_id, max(CASE WHEN st = 'l2' THEN -x.score ELSE x.score END) AS good FROM h WHERE x.chunk IS NOT NULL AND x.score IS NOT NULL AND isfinite(x.score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY good DESC, chunk_id) AS place FROM s)
"""
P7_SQL = (
    _P7_BASE
    + """, v AS (SELECT query_id, chunk_id, round(sum(weight / (60 + place)), 9) AS value FROM r GROUP BY ALL)
SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, chunk_id) AS k FROM v) WHERE k <= 3
"""
)


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Borda ranking of every query."""
    return rank_fusion.fuse(materialize(rank_fusion.list_ranks(table(spark, sf_dir, "ranked_lists")), "ranks")).select("query_id", F.col("item").alias("chunk_id"), F.round("points", 6).alias("points"), "rank")


P7_RANKING_SQL = (
    _P7_BASE
    + """, c AS (SELECT *, rank() OVER (PARTITION BY query_id, list_no ORDER BY good DESC) + (count(*) OVER (PARTITION BY query_id, list_no, good) - 1) / 2.0 AS cr, count(*) OVER (PARTITION BY query_id, list_no) AS m FROM r),
i AS (SELECT DISTINCT query_id, chunk_id FROM c), n AS (SELECT query_id, count(*) AS n FROM i GROUP BY 1), q AS (SELECT DISTINCT query_id, list_no, weight, m FROM c),
e AS (SELECT i.query_id, i.chunk_id, q.weight * (n.n - coalesce(c.cr, (q.m + 1 + n.n) / 2.0)) AS pts FROM i JOIN n USING (query_id) JOIN q USING (query_id) LEFT JOIN c ON c.query_id = i.query_id AND c.chunk_id = i.chunk_id AND c.list_no = q.list_no),
t AS (SELECT query_id, chunk_id, round(sum(pts), 9) AS p FROM e GROUP BY ALL)
SELECT query_id, chunk_id, round(p, 6) AS points, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, chunk_id) AS rank FROM t
"""
)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose parts the packing put into several containers, sizes by the fallback measure."""
    packed = packing.pack(packing.measured_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), CAPACITY)
    return packing.containers_of(packed).filter("parts > 1 AND containers > 1").select(F.col("id").alias("doc_id"))


P8_SQL = "SELECT doc_id FROM documents WHERE ceil(strlen(text) / 4.0) > 2048"


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens of a public tokenizer."""
    packed = packing.pack(packing.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), CAPACITY)
    return packed.select("container", F.col("id").alias("doc_id"), "part", "offset", "size", "tier", "window", "step_group")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must respect: no container over its capacity, each document once and whole (sizes by the fallback measure)."""
    packed = materialize(packing.pack(packing.measured_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), CAPACITY), "packed")
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    docs = packed.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("parts"))
    a = per.agg(F.sum((F.col("used") > CAPACITY).cast("long")).alias("overfull"), F.sum("used").alias("tokens"))
    return a.crossJoin(docs.agg(F.count("*").alias("documents"), F.sum((F.col("parts") > F.ceil(F.col("size") / CAPACITY)).cast("long")).alias("needless_cuts")))


P8_CONTAINERS_SQL = "SELECT 0::BIGINT AS overfull, sum(ceil(strlen(text) / 4.0))::BIGINT AS tokens, count(*) AS documents, 0::BIGINT AS needless_cuts FROM documents WHERE text <> ''"


def p8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every tiered packing must respect: no window over its size, no document longer than its window, each window in one container, and little room left."""
    packed = materialize(packing.pack(packing.measured_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), CAPACITY), "packed")
    w = packed.groupBy("tier", "window").agg(F.sum("size").alias("used"), F.max("size").alias("longest"), F.countDistinct("container").alias("containers"))
    bad = lambda c: F.sum(c.cast("long"))
    a = w.agg(bad(F.col("used") > F.col("tier")).alias("overfull"), bad(F.col("longest") > F.col("tier")).alias("misplaced"), bad(F.col("containers") > 1).alias("straddling"))
    fill = packed.agg((F.countDistinct("container") <= F.ceil(F.sum("size") / CAPACITY * 1.01) + 1).alias("filled"))
    return a.crossJoin(fill)


P8_TIERS_SQL = "SELECT 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS straddling, true AS filled"


def _sized(spark: SparkSession, sf_dir: str, tokens: bool = False) -> DataFrame:
    """Sizes by a public tokenizer or by the fallback measure, on which p9_found and the SQL are defined."""
    return mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source", None if tokens else packing.byte_quarter_size(F.col("text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their share even at the greatest permitted repetition: all permitted copies were drawn, and the budget is not reached."""
    _, report = mixing.draw(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    return report.filter("drawn = size * max_repeats AND drawn < budget").select("source")


_P9_BASE = """
WITH t AS (SELECT lower(trim(source, ' ' || chr(9))) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM source_targets GROUP BY 1),
z AS (SELECT lower(trim(source, ' ' || chr(9))) AS source, sum(ceil(strlen(text) / 4.0))::BIGINT AS size FROM documents WHERE text <> '' GROUP BY 1),
j AS (SELECT t.*, coalesce(z.size, 0) AS size FROM t LEFT JOIN z USING (source)),
w AS (SELECT *, sum(size) OVER () AS total FROM j)
"""
P9_SQL = _P9_BASE + "SELECT source FROM w WHERE size * max_repeats < target_share * total"


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws, sizes in tokens of a public tokenizer."""
    draws, _ = mixing.draw(_sized(spark, sf_dir, True), table(spark, sf_dir, "source_targets"))
    return draws.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares per source, of the tokens of a public tokenizer."""
    _, report = mixing.draw(_sized(spark, sf_dir, True), table(spark, sf_dir, "source_targets"))
    return report.select("source", "target_share", "max_repeats", "size", F.round("budget", 3).alias("budget"), "epochs", "drawn", F.round("share", 6).alias("share"), "short")


def p9_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan every draw must respect: budgets and whole epochs; and that no source exceeds its budget or cap."""
    _, r = mixing.draw(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    within = (F.col("drawn") <= F.col("budget") + 1e-6) & (F.col("drawn") <= F.col("size") * F.col("max_repeats")) & (F.col("drawn") >= F.col("epochs") * F.col("size"))
    return r.select("source", "size", F.round("budget", 3).alias("budget"), "epochs", within.alias("within"))


P9_EPOCHS_SQL = _P9_BASE + "SELECT source, size::BIGINT AS size, round(target_share * total, 3) AS budget, CASE WHEN size > 0 THEN least(floor(target_share * total / size), max_repeats) ELSE 0 END::BIGINT AS epochs, true AS within FROM w"


def _abuse(spark: SparkSession, sf_dir: str, carried: list[str] = ()) -> tuple[DataFrame, float]:
    documents = table(spark, sf_dir, "documents")
    model = abuse.train(documents, table(spark, sf_dir, "doc_labels"))
    return abuse.score_documents(documents, model, carried), model.threshold


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored as abusive, hateful or sexual."""
    scores, threshold = _abuse(spark, sf_dir)
    return scores.filter(F.col("score") >= threshold).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _abuse(spark, sf_dir)[0]


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of flagged documents per source."""
    return abuse.rates(*_abuse(spark, sf_dir, ["source"]))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_term_weights, p4_found, p4_pieces, p4_round_trip, p5_found, p5_nearest, p5_recall, p7_found, p7_ranking, p8_found, p8_packing, p8_containers, p8_tiers, p9_found, p9_draws, p9_shares, p9_epochs, p10_found, p10_scores, p10_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_SQL,
        "p2_term_weights": P2_WEIGHTS_SQL,
        "p4_found": P4_SQL,
        "p4_round_trip": P4_ROUND_TRIP_SQL,
        "p5_found": P5_SQL,
        "p5_recall": P5_RECALL_SQL,
        "p7_found": P7_SQL,
        "p7_ranking": P7_RANKING_SQL,
        "p8_found": P8_SQL,
        "p8_containers": P8_CONTAINERS_SQL,
        "p8_tiers": P8_TIERS_SQL,
        "p9_found": P9_SQL,
        "p9_epochs": P9_EPOCHS_SQL,
    }
