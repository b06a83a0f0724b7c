"""Tables of spans (key, start, end): which ones overlap, and which remain if those of better rank come first.

Spans of one key meet in buckets of BUCKET places that they share, so a key with very many spans is dealt to many tasks; a pair is told
once, in the first bucket that both reach. Ends are exclusive, and spans without length overlap nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.shared import kept

BUCKET = 256


def in_buckets(spans: DataFrame, width: int) -> DataFrame:
    """Each span once per bucket that it reaches."""
    reach = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return spans.filter(F.col("start") < F.col("end")).withColumn("_bucket", F.explode(reach))


def overlaps(left: DataFrame, right: DataFrame, *keys: str, width: int = BUCKET, condition: Column | None = None) -> DataFrame:
    """left and right (structs of all columns) of spans with equal keys that share a place. `condition` is over left.* and right.*."""
    side = lambda df, name: in_buckets(df, width).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_bucket").alias(f"_{name}_bucket"))
    a, b = side(left, "left"), side(right, "right")
    first = F.greatest(F.col("left.start"), F.col("right.start"))
    tests = [F.col(f"_left_{k}") == F.col(f"_right_{k}") for k in (*keys, "bucket")]
    tests += [F.col("left.start") < F.col("right.end"), F.col("right.start") < F.col("left.end"), F.floor(first / width) == F.col("_left_bucket")]
    if condition is not None:
        tests.append(condition)
    return a.join(b, reduce(Column.__and__, tests)).select("left", "right")


def chosen(spans: DataFrame, *keys: str, order: tuple[str, ...] = ("rank", "start", "end"), width: int = BUCKET, rounds: int = 1000) -> DataFrame:
    """The spans that remain if they are taken in the order of their columns `order`, and each one that overlaps a taken one goes.

    In each round those that no open one with an earlier place in the order overlaps are taken, and what they overlap goes; a round settles
    at least the first open span of each key, and usually nearly all of them. Spans that agree in keys and order count as one.
    """
    names = [*dict.fromkeys([*keys, "start", "end", *order])]
    rows = spans.filter(F.col("start") < F.col("end")).dropDuplicates(names)
    place = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in (*order, "start", "end")])
    pairs = overlaps(rows.select(*names), rows.select(*names), *keys, width=width, condition=place("left") < place("right"))
    pairs = kept(pairs)
    if pairs.isEmpty():
        return rows
    ident = lambda side, name: F.struct(*[F.col(f"{side}.{c}") for c in names]).alias(name)
    edges = pairs.select(ident("left", "winner"), ident("right", "loser"))
    gone = None
    for _ in range(rounds):
        # Winners that lose against nobody are taken; whoever they beat goes, and with it the pairs it is in.
        taken = edges.select("winner").distinct().join(edges.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti")
        out = kept(edges.join(taken, "winner", "left_semi").select("loser").distinct())
        gone = out if gone is None else gone.union(out)
        edges = edges.join(taken, "winner", "left_anti")
        edges = kept(edges.join(out, "loser", "left_anti").join(out.withColumnRenamed("loser", "winner"), "winner", "left_anti"))
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"{rounds} rounds did not settle all spans")
    mine = F.struct(*[F.col(c) for c in names])
    return rows.withColumn("_span", mine).join(gone.withColumnRenamed("loser", "_span"), "_span", "left_anti").drop("_span")
