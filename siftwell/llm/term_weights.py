"""How characteristic a term is of its record within the collection (BM25 term weights).

Defined results
- null terms, null or non-positive frequencies and records outside the collection: dropped;
- exact repeated rows: count once; spellings that fold to one term (trimmed, lower case) add up; an empty term is a term;
- empty tables: no rows; a collection without postings: no rows;
- ties: each row has its own weight, nothing is cut;
- extra columns: ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import materialize

#: A document-frequency table of up to so many terms is broadcast (at some 40 bytes a term); beyond it only the head is.
BROADCAST_TERMS = 200_000
#: Terms in more than this share of all rows are joined by broadcast in any case: there are at most 1 / HEAD_SHARE of them.
HEAD_SHARE = 1e-4


def folded_postings(postings: DataFrame, records: DataFrame, term: str = "term", record: str = "doc", tf: str = "tf", key: str = "chunk_id") -> DataFrame:
    """(record, term, tf, length): one row per record and folded term, of records in the collection.

    Exact copies are dropped with a fold in each task before the shuffle, so a hot row costs one row per task. All that
    follows is keyed by the record and shares one shuffle.
    """
    rows = postings.select(F.col(record).alias("record"), F.col(term).alias("_raw"), F.col(tf).cast("long").alias("tf"))
    rows = rows.filter("record IS NOT NULL AND _raw IS NOT NULL AND tf > 0").distinct()
    ids = records.select(F.col(key).alias("_id")).filter("_id IS NOT NULL").distinct()
    rows = rows.select("record", F.lower(F.trim("_raw")).alias("term"), "tf").repartition("record")
    sums = rows.join(ids, F.col("record") == F.col("_id"), "left_semi").groupBy("record", "term").agg(F.sum("tf").alias("tf"))
    lengths = sums.groupBy("record").agg(F.sum("tf").alias("length"))
    return sums.join(lengths, "record").select("record", "term", "tf", "length")


def with_document_frequency(rows: DataFrame) -> DataFrame:
    """Adds ``df``. The frequency table is broadcast if counted to be small; else only its bounded head is, and the
    tail, in which no term has more than HEAD_SHARE of the rows, is joined by shuffle."""
    df = materialize(rows.groupBy("term").agg(F.count("*").alias("df")), "df")
    size = df.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows")).first()
    if size["terms"] <= BROADCAST_TERMS:
        return rows.join(F.broadcast(df), "term")
    least = int(size["rows"] * HEAD_SHARE) + 1
    head = df.filter(F.col("df") >= least)
    with_head = rows.join(F.broadcast(head), "term", "left")
    hot = with_head.filter("df IS NOT NULL")
    tail = with_head.filter("df IS NULL").drop("df").join(df.filter(F.col("df") < least).hint("shuffle_merge"), "term")
    return hot.unionByName(tail)


def term_weights(postings: DataFrame, records: DataFrame, k1: float = 1.2, b: float = 0.75, **columns: str) -> DataFrame:
    """(record, term, tf, df, records, length, weight, flat) for each record and each of its terms.

    weight = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)):
    saturating in tf, normalised by length, over the records that have at least one posting. ``flat`` is what the weight's saturation
    divides by, tf + k1 * (1 - b + b * length / average length), over (k1 + 1).
    """
    rows = materialize(folded_postings(postings, records, **columns), "postings")
    stats = rows.groupBy("record").agg(F.first("length").alias("length")).agg(F.count("*").alias("records"), F.avg("length").alias("average")).first()
    n, average = stats["records"], float(stats["average"] or 1.0)
    tf, df = F.col("tf"), F.col("df")
    idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    flat = (tf + k1 * (1 - b + b * F.col("length") / average)) / (k1 + 1)
    return with_document_frequency(rows).select("record", "term", "tf", "df", F.lit(n).alias("records"), "length", (idf * tf / flat).alias("weight"), flat.alias("flat"))


def near_the_top(weights: DataFrame) -> DataFrame:
    """The rows of ``term_weights`` that can have the greatest tf * ln(N / df) of their record.

    weight * flat is tf * ln((N + 1) / (df + 0.5)), which departs from tf * ln(N / df) by tf * ln(1 + 0.5 / df) at most downwards (never more than
    tf * ln 1.5) and tf / (2 N) upwards. A row stays if the first lifts it to the best of its record lowered by the second.
    """
    value, tf = F.col("weight") * F.col("flat"), F.col("tf")
    best = weights.groupBy(F.col("record").alias("_r")).agg(F.max(value - tf / (2 * F.col("records"))).alias("_best"))
    return weights.join(best, F.col("record") == F.col("_r")).filter(value + tf * F.log(1 + 0.5 / F.col("df")) >= F.col("_best") - 2e-6).drop("_r", "_best")
