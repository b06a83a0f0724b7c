"""For each request (family, size, name) the candidate of its family that suits best: the one of that name, else the nearest in size.

Nearest sizes are found by sorting: requests' and candidates' sizes are united, and windows carry the last candidate before and the first
one after each request. Families are cut into ranges of sizes by quantiles, so that a family with a third of all rows takes many tasks; what lies
beyond a range's edge comes from a table of one row per range.

Cases: of candidates of one size the first name counts; of two at the same distance the smaller one; a request without a size (null or not
above 0, if `positive`) takes the largest candidate; a family without candidates gives null; a null family is a family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64
#: Cuts of families that are broadcast, one row per family.
FAMILIES_BROADCAST = 50_000


def _cuts(candidates: DataFrame, ranges: int) -> DataFrame:
    """_family and the sizes that cut its candidates into ranges."""
    shares = [k / ranges for k in range(1, ranges)]
    cuts = F.percentile_approx("size", shares, 1000) if shares else F.array().cast("array<double>")
    return candidates.groupBy(F.col("family").alias("_family")).agg(cuts.alias("_cuts"))


def _in_ranges(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    right = F.broadcast(cuts) if cuts.limit(FAMILIES_BROADCAST + 1).count() <= FAMILIES_BROADCAST else cuts
    part = F.size(F.filter("_cuts", lambda c: c < F.col("size")))
    return rows.join(right, F.col("family").eqNullSafe(F.col("_family"))).withColumn("_part", part).drop("_family", "_cuts")


def nearest_sizes(requests: DataFrame, candidates: DataFrame, ranges: int = RANGES) -> DataFrame:
    """family, size and nearest (size, name) of each distinct request (family, size) that has candidates (family, size, name)."""
    offers = candidates.filter("size is not null").groupBy("family", "size").agg(F.min("name").alias("name"))
    wanted = requests.filter("size is not null").select("family", "size").distinct()
    cuts = _cuts(offers, ranges)
    offer = F.struct("size", "name")
    rows = _in_ranges(offers.select("family", "size", offer.alias("offer")).unionByName(wanted.withColumn("offer", F.lit(None).cast(offers.select(offer).schema[0].dataType))), cuts)
    edges = rows.filter("offer is not null").groupBy("family", "_part").agg(F.min("offer").alias("low"), F.max("offer").alias("high"))
    # Ranges of a family: one row each, RANGES at most.
    places = rows.select("family", "_part").distinct().join(edges.withColumnsRenamed({"family": "_f", "_part": "_p"}), F.col("family").eqNullSafe(F.col("_f")) & (F.col("_part") == F.col("_p")), "left")
    order = W.partitionBy("family").orderBy("_part")
    places = places.select(F.col("family").alias("_f"), F.col("_part").alias("_p"), F.last("high", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("low", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    rows = rows.join(places, F.col("family").eqNullSafe(F.col("_f")) & (F.col("_part") == F.col("_p")))
    line = W.partitionBy("family", "_part").orderBy("size", F.col("offer").isNull())  # at one size the candidate comes first
    below = F.coalesce(F.last("offer", True).over(line.rowsBetween(W.unboundedPreceding, -1)), F.col("_before"))
    above = F.coalesce(F.first("offer", True).over(line.rowsBetween(1, W.unboundedFollowing)), F.col("_after"))
    rows = rows.select("family", "size", "offer", below.alias("below"), above.alias("above")).filter("offer is null")
    gap = lambda c: F.abs(F.col(c)["size"] - F.col("size"))
    best = F.when(F.col("below").isNull() | (gap("above") < gap("below")), F.col("above")).otherwise(F.col("below"))
    return rows.select("family", "size", best.alias("nearest"))


def resolved(requests: DataFrame, candidates: DataFrame, ranges: int = RANGES, positive: bool = True) -> DataFrame:
    """Adds to requests (family, size, name) the struct `found` of the candidate's name and size, and how it was found: name, size or largest."""
    known: Column = F.col("size").isNotNull() & (F.col("size") > 0) if positive else F.col("size").isNotNull()
    exact = candidates.groupBy(F.col("family").alias("_f1"), F.col("name").alias("_n1")).agg(F.max("size").alias("_s1"))
    near = nearest_sizes(requests.filter(known), candidates, ranges).select(F.col("family").alias("_f2"), F.col("size").alias("_s2"), F.col("nearest").alias("_near"))
    # Of several largest ones the first name.
    size = F.coalesce(F.col("size").cast("double"), F.lit(float("-inf")))
    top = candidates.groupBy("family", "name").agg(F.max(size).alias("_size"), F.max("size").alias("size"))
    most = top.groupBy("family").agg(F.max("_size").alias("_most")).withColumnRenamed("family", "_f3")
    largest = top.join(most, F.col("family").eqNullSafe(F.col("_f3")) & (F.col("_size") == F.col("_most"))).groupBy(F.col("_f3")).agg(F.min(F.struct("name", "size")).alias("_largest"))
    same = lambda c: F.col("family").eqNullSafe(F.col(c))
    out = requests.join(exact, same("_f1") & (F.col("name") == F.col("_n1")), "left").join(near, same("_f2") & (F.col("size") == F.col("_s2")) & known, "left").join(largest, same("_f3"), "left")
    pick = lambda name, size, how: F.struct(name.alias("name"), size.alias("size"), F.lit(how).alias("how"))
    found = (
        F.when(F.col("_n1").isNotNull(), pick(F.col("_n1"), F.col("_s1"), "name"))
        .when(known & F.col("_near").isNotNull(), pick(F.col("_near.name"), F.col("_near.size"), "size"))
        .when(F.col("_largest").isNotNull(), pick(F.col("_largest.name"), F.col("_largest.size"), "largest"))
    )
    return out.select(*[F.col(f"`{c}`") for c in requests.columns], found.alias("found"))
