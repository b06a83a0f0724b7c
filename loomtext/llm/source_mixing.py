"""Mixing sources to target sizes by hash-threshold histograms, without sorting documents.

A document's hash places it on a line. Of each source the mix takes the documents below a threshold, a whole number of times and once
more. The threshold comes from nested histograms: sizes summed by source and leading hash bits name the bucket in which the budget
ends, and only that bucket is split by the next bits, until a single hash is left. It is taken if that brings the source nearer to
its target. Budgets nest: a larger one keeps what a smaller one took, and reruns agree.

Targets share SHARE times the whole by weight. A target above CAP times its source stops there and the excess is shared out again;
that ends at one level l with target = min(cap, l * weight).

Cases: null and empty texts have size 0; a null source is a source, last in order; rows that share a doc_id share a hash and are
taken together; a null doc_id hashes like an empty string; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import WORD, with_row, salted, settled

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12
SOURCES_BROADCAST = 20_000
SALTS = 32


def position(doc_id: Column) -> Column:
    """The document's place on the line: the leading 60 bits of the MD5 of its id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), position(F.col("doc_id")).alias("place"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: one row per source, so the windows without a key hold no more rows than sources."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    out = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    of = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level rises as small sources reach their caps and falls beyond the last of them.
    out = out.withColumn("level", left / of).withColumn("level", F.max("level").over(everything))
    return out.select("source", "source_size", F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, repeats, last: a document is taken `repeats` times, and once more if its place is at most `last`."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = settled(wanted.withColumn("repeats", repeats).withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")))
    bound, rows = wanted.select("source", "budget", F.lit(0).cast("long").alias("below")), sizes
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        counts = rows.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        counts = salted(counts, bound.select("source", "budget", "below"), ["source"], SALTS, F.col("bucket"), SOURCES_BROADCAST)
        upto = F.col("below") + F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        over = counts.withColumn("upto", upto).filter(F.col("upto") > F.col("budget"))
        least = F.min_by(F.struct("bucket", "upto", "size", "budget"), "bucket").alias("b")
        bound = over.groupBy("source").agg(least).select(
            "source", "b.budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.size")).alias("below"), F.col("b.size").alias("edge")
        )
        bound = settled(bound)
        if shift:  # only the boundary buckets' rows go on
            marked = salted(rows.withColumn("prefix", F.shiftright("place", shift)), bound.select("source", "prefix", F.lit(True).alias("held")), ["source", "prefix"], SALTS, F.col("doc_id"), SOURCES_BROADCAST)
            rows = settled(marked.filter("held").select(*sizes.columns))
    nearer = F.col("below") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("below")
    last = bound.select(F.col("source").alias("s"), F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))
    both = wanted.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return settled(both.select("source", "source_size", "target", "repeats", F.coalesce("last", F.lit(-1)).cast("long").alias("last")))


def times() -> Column:
    return F.col("repeats") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)


def plan_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of the document."""
    sizes = settled(sized(docs))
    limits = thresholds(sizes, targets(sizes))
    out = salted(sizes, limits, ["source"], SALTS, F.col("doc_id"), SOURCES_BROADCAST)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Texts are not shuffled unless sources are very many."""
    sizes = settled(sized(docs))
    limits = thresholds(sizes, targets(sizes)).select("source", "repeats", "last")
    rows = with_row(docs, "source", "doc_id").withColumn("place", position(F.col("doc_id")))
    rows = salted(rows, limits, ["source"], SALTS, F.col("doc_id"), SOURCES_BROADCAST)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times().cast("int")))).select("row.*")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for op3_source_mixing, with running sums in the order of the hashes."""
    weights = ", ".join(f"{w}.0" for w in WEIGHTS)
    return f"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {HASH_BITS // 4}))::bigint place
  from documents),
per_source as (select source, sum(size)::bigint source_size, sum(size)::double * {CAP} cap from sizes group by source),
weighed as (select *, ([{weights}]::double[])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)})::int + 1] weight from per_source),
levels as (
  select *, (sum(source_size) over ()::double * {SHARE} - coalesce(sum(cap) over before, 0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0)) level
  from weighed window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
wanted as (select source, source_size, least(cap, greatest(max(level) over (), 0) * weight) target from levels),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end repeats from wanted),
rows_ as (
  select d.doc_id, d.size, d.place, d.source, b.source_size, b.target, b.repeats, b.target - b.repeats * b.source_size budget,
    sum(d.size) over (partition by d.source order by d.place) upto
  from sizes d join budgets b on d.source is not distinct from b.source),
edges as (
  select source, min(place) place, min(upto) upto, min(budget) budget from rows_ where upto > budget group by source),
lasts as (
  select e.source, case when e.upto - e.budget < e.budget - (e.upto - sum(d.size)) then e.place else e.place - 1 end last_place
  from edges e join sizes d on d.source is not distinct from e.source and d.place = e.place group by e.source, e.place, e.upto, e.budget)
select doc_id, size::bigint size, source_size, target, (size * (repeats + case when place <= last_place then 1 else 0 end))::bigint taken
from rows_ r left join lasts l on r.source is not distinct from l.source"""
