"""Mixing sources to target weights: weighted sampling without replacement inside capped epochs.

Each source gets a budget, its target share of the total size. It first gives whole epochs (every document once) while they fit
into the budget and the cap; the rest of the budget is drawn by Efraimidis-Spirakis keys: an exponential variate divided
by the document's quality weight, smallest first, until the running size reaches what is left of the budget.

The running sums are taken over buckets that follow the key, so a source with any share of the rows is spread over
many tasks; only one line per source goes to the driver's plan, and it is bounded by the target table.

Defined results
- null or empty texts: not drawn; null or unknown sources: not drawn, and not part of the total;
- spellings of a source (blanks and tabs around it, upper case) are one source; several target rows of one: the greatest share and cap;
- null targets count as 0, null or negative caps as 0; a source without documents has size 0 and draws nothing;
- weights of any scale: only their ratios within a source count; null, non-finite or tiny ones: the least share of the source's greatest;
- ties in the key: by id, then size;
- repeated rows: each row is a document; empty tables: a report of zeros, no draws; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import packing
from siftwell.operators.ranking import positions
from siftwell.session import materialize

_BUCKETS = 256
LEAST_WEIGHT = 0.05
#: A plan of up to so many sources is broadcast.
BROADCAST_SOURCES = 10_000


def canonical_source(c: Column) -> Column:
    return F.lower(F.trim(c, F.lit(" \t")))


def quality_weight(text: Column) -> Column:
    """A weight in [LEAST_WEIGHT, 1] for running text of varied words; boilerplate, encoded data and fragments weigh less.

    The product of five signs, each from 0 to 1: the share of letters and blanks; words of a usual length (3 to 12 letters on average, or a
    script without blanks); varied words (distinct over all, against what a text of that length usually has); few repeated lines; enough
    words to say something. All are expressions of the JVM over one split of the text.
    """
    words = F.filter(F.split(text, r"[^\p{L}\p{M}]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.size(words)
    letters = F.length(F.array_join(words, "")) + n
    unspaced = F.octet_length(text) > F.lit(2.5) * F.length(text)  # scripts of three bytes a letter
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    mean = letters / F.greatest(n, F.lit(1))
    usual = F.when(unspaced, 1.0).otherwise(clipped((mean - 1) / 2) * clipped((F.lit(30.0) - mean) / 18))
    varied = F.when(unspaced, 1.0).otherwise(clipped(F.size(F.array_distinct(words)) / F.pow(F.greatest(n, F.lit(1)).cast("double"), 0.75)))
    repeated = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    enough = clipped(F.lit(0.3) + F.length(text) / F.lit(500.0))
    return F.greatest(F.lit(LEAST_WEIGHT), clipped(letters / F.length(text)) * usual * varied * repeated * enough)


def sampling_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the id: the same draw on every run and every cluster. ``weight`` is at most 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), identity), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.when(weight.isNull() | F.isnan(weight) | (weight < LEAST_WEIGHT) | (weight > 1), LEAST_WEIGHT).otherwise(weight)


def clean_targets(targets: DataFrame) -> DataFrame:
    share = F.when(F.isnan("target_share") | (F.col("target_share") < 0), 0.0).otherwise(F.coalesce("target_share", F.lit(0.0)))
    rows = targets.select(canonical_source(F.col("source")).alias("source"), share.alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    return rows.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: size, total, budget, epochs (whole ones), rest (budget of the fractional draw), short; greatest
    is the source's greatest weight.

    ``documents`` has (source, size) and may have a weight. A source is short if all its permitted epochs stay under its budget.
    """
    usable = F.when(~F.isnan("weight") & (F.col("weight") < float("inf")), F.col("weight")) if "weight" in documents.columns else F.lit(1.0)
    sizes = documents.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_size"), F.max(usable).alias("greatest"))
    t = clean_targets(targets).join(sizes, F.col("source") == F.col("_s"), "left").select("source", "target_share", "max_repeats", F.coalesce("_size", F.lit(0)).alias("size"), F.when(F.col("greatest") > 0, F.col("greatest")).otherwise(1.0).alias("greatest"))
    total = t.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    p = t.crossJoin(F.broadcast(total)).withColumn("budget", F.col("target_share") * F.col("total"))
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats"))).otherwise(0).cast("long")
    p = p.withColumn("epochs", whole)
    rest = F.when((F.col("epochs") < F.col("max_repeats")) & (F.col("size") > 0), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0.0)
    return p.withColumn("rest", rest).withColumn("short", F.col("size") * F.col("max_repeats") < F.col("target_share") * F.col("total"))


def sized(df: DataFrame, key: str, text: str, source: str, size: Column | None, weight: Column | None = None, tokenizer: str = packing.TOKENIZER) -> DataFrame:
    """(id, source, size, weight) of the non-empty texts with a source; without ``size`` it is the number of tokens by a public tokenizer."""
    rows = df.select(F.col(key).alias("id"), canonical_source(F.col(source)).alias("source"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> '' AND source IS NOT NULL")
    weight = (weight if weight is not None else quality_weight(F.col("text"))).alias("weight")
    if size is None:
        return packing.counted(rows.select("id", "source", weight, "text"), tokenizer).select("id", "source", "size", "weight")
    return rows.select("id", "source", size.cast("long").alias("size"), weight)


def draw(documents: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(draws, report).

    draws: (source, id, epoch, size), epoch counting from 1; report: the plan with ``drawn`` and ``share`` (of all drawn).
    ``documents`` has (id, source, size, weight).
    """
    docs = materialize(documents, "sized")
    p = materialize(plan(docs, targets), "plan")
    budgets = p.select(F.col("source").alias("_t"), "epochs", "rest", "max_repeats", "greatest")
    known = docs.join(F.broadcast(budgets) if p.count() <= BROADCAST_SOURCES else budgets, F.col("source") == F.col("_t")).drop("_t")
    keyed = known.withColumn("key", sampling_key(F.col("id"), F.col("weight") / F.col("greatest"), seed))
    bucket = F.floor(_BUCKETS * (1 - F.exp(-F.col("key") / 2)))
    summed = positions(keyed, ["source"], bucket, [F.asc("key"), F.asc("id"), F.asc("size")], weight="size", running="until")
    copies = F.col("epochs") + F.when(F.col("until") <= F.col("rest"), 1).otherwise(0)
    taken = summed.withColumn("copies", copies.cast("int")).filter("copies > 0")
    draws = taken.select("source", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"), "size")
    drawn = taken.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("size") * F.col("copies")).alias("_drawn"))
    report = p.join(drawn, F.col("source") == F.col("_s"), "left").withColumn("drawn", F.coalesce("_drawn", F.lit(0))).drop("_s", "_drawn", "greatest")
    all_drawn = report.agg(F.sum("drawn").alias("_all"))
    report = report.crossJoin(F.broadcast(all_drawn)).withColumn("share", F.when(F.col("_all") > 0, F.col("drawn") / F.col("_all")).otherwise(0.0)).drop("_all")
    return draws, report
