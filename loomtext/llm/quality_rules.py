"""Quality rules with fixed base limits and adaptive limits per language and source.

The base rules count words, symbols, repeated lines and repeated five-word windows. Rates of documents that pass them go into
quantile sketches: histograms over buckets of bounded relative width, held as rows (group, rate, bucket, count). Sketches merge by
adding counts, so partial counts of a hot source meet as a few hundred rows. Each language's sketch takes in the corpus' as PRIOR
documents more, and each source's that of its language, so the fewer documents a group has the more its limits are its parent's.

Limits are fences that the sketches alone decide: as far beyond an outer quantile as that lies from the median. Documents outside
them are rejected. Which quantile is a parameter of the rate: 0.9 for symbols, since a tenth of a source may be junk, 0.99 for repeats.
Where so many documents of a group have none of what a rate counts that its outer quantile is 0, those that have some are the group's
outliers, and their own sketch sets the fence: half of their lower quantile. So a few symbols in a long clean text are no fault where junk
has many.

Everything is built from DataFrame functions: no Python runs on the executors.

Cases: a null or empty text has no words and is rejected by the base rule; null languages and sources are groups of their own;
repeated rows are judged each; an empty table gives an empty result; columns beside doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import SPACE, WORD, with_row, salted, settled, small

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
#: Most words in repeated windows, per cent of all words.
MAX_REPEAT = 20
#: Documents whose weight a parent's sketch has in its children's: the corpus in a language's, the language in those of its sources.
PRIOR = 100
#: Leading bits that a bucket keeps: its width is at most 1/32 of its values.
BITS = 6
#: Rates by name: (numerator, denominator, scale, lower and upper quantile from which fences are set, in per mille; None: no fence).
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, None, 900),
    "word_length": ("word_chars", "n_words", 100, 10, 950),
    "line_rate": ("n_dup_lines", "n_lines", 1000, None, 990),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, None, 990),
}
#: The lower quantile, in per mille, of the documents whose rate is not 0.
SOME = 100
#: A fence lies so many times the distance from the median to the outer quantile beyond the outer quantile.
STRETCH = 1
GROUPS_BROADCAST, IDS_BROADCAST = 20_000, 1_000_000
SALTS = 32


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules, for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = lambda a, i: F.get(F.col(a), i)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id", "lang", "source",
        F.filter(F.split(text, SPACE), lambda x: x != "").alias("w"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    out = out.withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    out = out.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Hashes of the windows; a text without equal ones is done here.
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[at("w", i + k) for k in range(WINDOW)]))
    out = out.withColumn("h", F.when(F.size("w") > WINDOW, windows))
    out = out.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    # Equal windows stand side by side in order; each one's place counts its words up to the next place.
    ordered = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("s", F.when(F.col("again"), ordered))
    twin = lambda x, i: (at("s", i - 1)["h"] == x["h"]) | (at("s", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(twin(x, i), at("s", i + 1)["h"] == x["h"], at("s", i - 1)["h"] == x["h"])), lambda x: x["i"]))
    out = out.withColumn("p", F.when(F.col("again"), places))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(at("p", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def bucket(value: Column) -> Column:
    """The lower end of a whole number's bucket: its leading bits, the others cleared."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def rates(counts: DataFrame) -> DataFrame:
    """The bucketed rates of each document, null where the denominator is 0."""
    for name, (top, bottom, scale, _, _) in RATES.items():
        rate = F.when(F.col(bottom) > 0, F.floor(F.col(top) * scale / F.col(bottom)).cast("long"))
        counts = counts.withColumn(name, bucket(rate))
    return counts


def sketches(rated: DataFrame) -> DataFrame:
    """Rows (lang, source, rate, bucket, n) over the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("bucket")) for r in RATES]))
    rows = rated.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("x")).select("lang", "source", "x.*")
    return rows.filter(F.col("bucket").isNotNull()).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").cast(EXACT).alias("n"))


#: Weights of buckets are whole numbers, so that every order of adding them gives the same quantiles.
EXACT = "decimal(38,0)"


def shrunk(own: DataFrame, keys: list[str], parent: DataFrame) -> DataFrame:
    """The sketches of groups (keys, rate, bucket, n), mixed with their parents' (sketches by fewer of the keys) as PRIOR documents more.

    Weights are multiples of the parent's total, so they stay whole numbers: n * total + PRIOR * parent's n.
    """
    up = [k for k in keys if k in parent.columns]
    total = parent.groupBy(*up, "rate").agg(F.sum("n").cast(EXACT).alias("total"))
    rename = lambda df: df.select(*[F.col(k).alias(f"up_{k}") for k in (*up, "rate")], *[c for c in df.columns if c not in (*up, "rate")])
    same = lambda: [F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in (*up, "rate")]
    mine = own.join(rename(total), same()).select(*keys, "rate", "bucket", (F.col("n") * F.col("total")).cast(EXACT).alias("n"))
    groups = own.select(*keys, "rate").distinct()
    theirs = groups.join(rename(parent), same()).select(*keys, "rate", "bucket", (F.col("n") * PRIOR).cast(EXACT).alias("n"))
    return mine.union(theirs).groupBy(*keys, "rate", "bucket").agg(F.sum("n").cast(EXACT).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Median and outer quantiles per key and rate, read from merged sketches."""
    part = W.partitionBy(*keys, "rate")
    merged = sketch.withColumn("upto", F.sum("n").over(part.orderBy("bucket")).cast("decimal(38,0)") * 1000).withColumn("total", F.sum("n").over(part))
    level = lambda side: F.coalesce(*[F.when(F.col("rate") == r, F.lit(x[side])) for r, x in RATES.items()])
    reach = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))
    # The same over the buckets above 0.
    some = F.when(F.col("bucket") > 0, F.col("n")).otherwise(F.lit(0)).cast(EXACT)
    merged = merged.withColumn("upto_some", F.sum(some).over(part.orderBy("bucket")).cast("decimal(38,0)") * 1000).withColumn("total_some", F.sum(some).over(part))
    above = lambda q: F.min(F.when((F.col("bucket") > 0) & (F.col("upto_some") >= F.col("total_some") * q), F.col("bucket")))
    return merged.groupBy(*keys, "rate").agg(reach(level(3)).alias("low"), reach(F.lit(500)).alias("mid"), reach(level(4)).alias("high"), above(SOME).alias("some_low"))


def upper_fence() -> Column:
    """From the quantiles of a group's rate, as whole numbers."""
    usual = F.col("high") + STRETCH * (F.col("high") - F.col("mid"))
    return F.when(F.col("high") > 0, usual).otherwise(F.coalesce(F.floor(F.col("some_low") / 2).cast("long"), F.lit(0)))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and for each rate its lower and upper fence, from the sketches of groups shrunk toward their language's and the corpus'."""
    merged = lambda keys: sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").cast(EXACT).alias("n"))
    of_lang = shrunk(merged(["lang"]), ["lang"], merged([]))
    both = quantiles(shrunk(sketch, ["lang", "source"], of_lang), ["lang", "source"])
    found = []
    for name, (_, _, _, low, high) in RATES.items():
        here = F.col("rate") == name
        found += [F.max(F.when(here, upper_fence())).alias(f"{name}_upper")] if high else []
        found += [F.max(F.when(here, F.col("low") - STRETCH * (F.col("mid") - F.col("low")))).alias(f"{name}_lower")] if low else []
    return both.groupBy("lang", "source").agg(*found)


def judge(docs: DataFrame) -> DataFrame:
    """Every document with its counts, its rates' buckets, the fences that hold for it and the verdict `kept`."""
    rated = settled(rates(base_counts(docs)))
    fences = settled(limits(sketches(rated)))
    out = salted(rated, fences, ["lang", "source"], SALTS, F.col("doc_id"), GROUPS_BROADCAST)
    inside = ~F.col("base_failed")
    for name, (_, _, _, low, high) in RATES.items():
        inside &= F.coalesce(F.col(name) <= F.col(f"{name}_upper"), F.lit(True)) if high else F.lit(True)
        inside &= F.coalesce(F.col(name) >= F.col(f"{name}_lower"), F.lit(True)) if low else F.lit(True)
    return out.withColumn("kept", inside)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that all rules keep, with all their columns. Rows that share a doc_id stay or go together: any rejected row rejects it.

    Texts are shuffled only if more than IDS_BROADCAST documents go.
    """
    gone = judge(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = F.broadcast(gone) if small(gone, IDS_BROADCAST) else gone
    return with_row(docs, "doc_id").join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def oracle_sql() -> str:
    """DuckDB SQL for op5_quality_rules."""
    bucketed = "(x >> greatest(length(bin(x)) - {b}, 0)) << greatest(length(bin(x)) - {b}, 0)".format(b=BITS)
    rate = lambda top, bottom, scale: f"case when {bottom} > 0 then ({top} * {scale}) // {bottom} end"
    rows = " union all ".join(f"select doc_id, lang, source, base_failed, '{r}' rate, {rate(*x[:3])} x from counts" for r, x in RATES.items())
    level = lambda side: "case rate " + " ".join(f"when '{r}' then {x[side]}" for r, x in RATES.items() if x[side]) + " end"
    reach = lambda q: f"min(case when upto * 1000 >= total * {q} then b end)"
    above = lambda q: f"min(case when b > 0 and upto_some * 1000 >= total_some * {q} then b end)"
    return f"""
with w as (
  select doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls
  from documents),
places as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w)),
again as (select doc_id, g from places group by all having count(*) > 1),
covered as (select doc_id, count(distinct i + k) n from places join again using (doc_id, g), (select unnest(range(0, {WINDOW})) k) group by doc_id),
counts as (
  select w.doc_id, lang, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) n_symbols,
    len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words,
    len(ws) < {MIN_WORDS} or 100 * coalesce(covered.n, 0) > {MAX_REPEAT} * len(ws) base_failed
  from w left join covered using (doc_id)),
rated as (select doc_id, lang, source, base_failed, rate, {bucketed} b from ({rows}) where x is not null),
own as (select lang, source, rate, b, count(*)::hugeint n from rated where not base_failed group by all),
whole as (select rate, b, sum(n)::hugeint n from own group by all),
lang_own as (select lang, rate, b, sum(n)::hugeint n from own group by all),
of_lang as (
  select lang, rate, b, sum(n)::hugeint n from (
    select lang, l.rate, b, l.n * t.total n from lang_own l join (select rate, sum(n)::hugeint total from whole group by all) t on l.rate = t.rate
    union all select g.lang, g.rate, p.b, p.n * {PRIOR} from (select distinct lang, rate from lang_own) g join whole p on g.rate = p.rate) group by all),
mixed as (
  select lang, source, rate, b, sum(n)::hugeint n from (
    select o.lang, source, o.rate, b, o.n * t.total n
    from own o join (select lang, rate, sum(n)::hugeint total from of_lang group by all) t on o.rate = t.rate and o.lang is not distinct from t.lang
    union all select g.lang, source, g.rate, p.b, p.n * {PRIOR}
    from (select distinct lang, source, rate from own) g join of_lang p on g.rate = p.rate and g.lang is not distinct from p.lang) group by all),
picked as (
  select lang, source, rate, {reach(level(3))} low, {reach(500)} mid, {reach(level(4))} high, {above(SOME)} some_low
  from (select *, sum(n) over part upto, sum(n) over whole_part total, coalesce(sum(n) filter (b > 0) over part, 0) upto_some, coalesce(sum(n) filter (b > 0) over whole_part, 0) total_some
    from mixed window part as (partition by lang, source, rate order by b), whole_part as (partition by lang, source, rate)) group by all),
fences as (
  select lang, source, rate, case when high > 0 then high + {STRETCH} * (high - mid) else coalesce(some_low // 2, 0) end upper, low - {STRETCH} * (mid - low) lower from picked),
outside as (
  select distinct doc_id from rated r join fences f
  on r.lang is not distinct from f.lang and r.source is not distinct from f.source and r.rate = f.rate where b > upper or b < lower)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from outside) kept
from counts"""
