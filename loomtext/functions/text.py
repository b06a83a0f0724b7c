"""Words, sentences and n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda, an expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters; runs that hold digits are dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"), F.lit(0))


def spaced(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty parts between runs of full stops, exclamation and question marks."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours, joined by a space. `items` should be a plain column, since it is read for each of them."""
    some = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.concat_ws(" ", *[F.get(items, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(items) >= n, some).otherwise(F.array().cast("array<string>"))


def with_counts(df: DataFrame, items: Column, name: str) -> DataFrame:
    """Adds the array of multiplicities of the distinct items, within each row: sorted, equal ones are neighbours. Nothing is shuffled."""
    ordered, first = f"_{name}_ordered", f"_{name}_first"
    df = df.withColumn(ordered, F.sort_array(items))
    starts = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(F.col(ordered), i - 1) != x), i)), lambda i: i.isNotNull())
    df = df.withColumn(first, starts)
    df = df.withColumn(name, F.transform(first, lambda x, i: F.coalesce(F.get(F.col(first), i + 1), F.size(ordered)) - x))
    return df.drop(ordered, first)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def hashed(items: Column) -> Column:
    """64-bit names of the items: sorting and comparing numbers takes less than doing so with strings."""
    return F.transform(items, lambda w: F.xxhash64(w))


def neighbours(names: Column, more: Column) -> Column:
    """Names of runs: each of `names` with the one of `more` that follows it. `more` is the items' names, and `names` those of runs of n - 1."""
    count = F.greatest(F.size(names) - 1, F.lit(0))
    return F.zip_with(F.slice(names, F.lit(1), count), F.slice(more, F.size(more) - count + 1, count), lambda a, b: F.xxhash64(a, b))


def repeats(ordered: Column) -> Column:
    """Of sorted items those that equal the one before: c - 1 of each that occurs c times. `ordered` is a plain column or a lambda's."""
    return F.filter(ordered, lambda x, i: F.coalesce(x == F.get(ordered, i - 1), F.lit(False)))


def multiplicities(ordered: Column) -> Column:
    """How often each distinct item occurs, from sorted items without nulls: the distances between the places where an item differs from the
    one before. `ordered` is a plain column or a lambda's."""
    places = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    starts = F.filter(F.slice(places, F.lit(1), F.size(ordered)), lambda i: F.coalesce(F.get(ordered, i) != F.get(ordered, i - 1), F.lit(True)))
    return let(starts, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda i, j: F.coalesce(j, F.size(ordered)) - i))


def entropy_of_counts(count: Column, counts: Column) -> Column:
    """Shannon entropy in bits of so many items, from how often each distinct one occurs."""
    return F.when(count > 0, F.greatest(F.log2(count) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / count, F.lit(0.0)))


def entropy_of(count: Column, again: Column) -> Column:
    """Shannon entropy in bits of the distribution of so many items, from their repeats: log2(n) - sum of c * log2(c) / n."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(1).alias("run"), F.lit(0.0).alias("sum"))

    def add(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(2)
        return F.struct(x.alias("last"), run.alias("run"), (a["sum"] + run * F.log2(run) - (run - 1) * F.log2(run - 1)).alias("sum"))

    folded = F.aggregate(again, start, add, lambda a: a["sum"])
    return F.when(count > 0, F.greatest(F.log2(count) - folded / count, F.lit(0.0)))


def entropy(items: Column) -> Column:
    return let(F.sort_array(hashed(items)), lambda s: entropy_of(F.size(s), repeats(s)))


#: Numbers of one part of a running sum: what lies before a part is summed once.
PART = 128


def sums_before(values: Column) -> Column:
    """For each of an array's whole numbers the sum of those before it. `values` is a plain column or a lambda's.

    Each number adds up those before it in its part, and the sums of the parts before, so the work grows with the array and not its square
    up to some ten thousand parts.
    """
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / PART).cast("int"), F.lit(0))), lambda k: add(F.slice(values, k * PART + 1, F.lit(PART))))
    before = let(parts, lambda p: F.transform(p, lambda _, k: add(F.slice(p, F.lit(1), k))))
    place = lambda i: F.floor(i / PART).cast("int")
    return let(before, lambda b: F.transform(values, lambda _, i: F.get(b, place(i)) + add(F.slice(values, place(i) * PART + 1, i % PART))))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def variance(values: Column) -> Column:
    """Population variance."""

    def of(v: Column) -> Column:
        squares = let(total(v) / F.size(v), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.when(F.size(v) > 0, squares / F.size(v))

    return let(values, of)
