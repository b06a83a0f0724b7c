"""Metrics of pairs of texts (original, rewrite), as column expressions, and their registry."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.functions import matching
from loomtext.functions import text as T
from loomtext.operators.shared import in_small_batches

# What numbers, placeholders, citations, headings and tokens look like.
DRIFT_NUMBER = r"\b\d+\.?\d*\b"
NUMBER = r"\b\d+(?:\.\d+)?%?"
PLACEHOLDER = r"\[(?:MATH|TERM)_\d{3}\]"
CITATION = r"\[\d+\]"
HEADINGS = r"(?m)^#{1,6}\s+.+$|\\(?:sub)*section\{[^}]+\}"
TOKEN = r"\[(?:MATH|TERM)_\d{3}\]|\d+(?:\.\d+)?%?|[a-z]+(?:-[a-z]+)*"

METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def metric(name: str):
    """Registers a metric; a name can be taken once."""

    def add(f):
        if name in METRICS:
            raise ValueError(f"metric {name} is already there")
        METRICS[name] = f
        return f

    return add


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def kept_share(before: Column, after: Column, none: float) -> Column:
    """Share of the distinct items before that are among those after; `none` if there are none before."""
    return T.let(F.array_distinct(before), lambda x: F.when(F.size(x) == 0, F.lit(none)).otherwise(F.size(F.array_intersect(x, after)) / F.size(x)))


@metric("numeric_drift")
def numeric_drift(a: Column, b: Column) -> Column:
    return kept_share(found(a, DRIFT_NUMBER), found(b, DRIFT_NUMBER), 0.0)


@metric("citation_drift")
def citation_drift(a: Column, b: Column) -> Column:
    return kept_share(found(a, CITATION), found(b, CITATION), 1.0)


def entities(text: Column) -> Column:
    """Capitalized words of letters only that do not begin a sentence."""
    edge = r"""^[.,;:!?"'()\[\]]+|[.,;:!?"'()\[\]]+$"""

    def of(words: Column) -> Column:
        before = F.concat(F.array(F.lit(".")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
        rows = F.zip_with(words, before, lambda w, b: F.when(~b.rlike(r"[.!?]$"), F.regexp_replace(w, edge, "")))
        return F.filter(rows, lambda w: w.isNotNull() & w.rlike(r"^\p{Lu}\p{L}*$"))

    return T.let(T.spaced(text), of)


@metric("entity_drift")
def entity_drift(a: Column, b: Column) -> Column:
    return kept_share(entities(a), entities(b), 1.0)


@metric("heading_preservation")
def heading_preservation(a: Column, b: Column) -> Column:
    """Headings count as often as they occur."""
    both = F.struct(found(a, HEADINGS).alias("a"), found(b, HEADINGS).alias("b"))
    return T.let(both, lambda x: F.when(F.size(x["a"]) == 0, 1.0).otherwise(F.size(F.filter(x["a"], lambda h: F.array_contains(x["b"], h))) / F.size(x["a"])))


@metric("sentence_length_variance")
def sentence_length_variance(a: Column, b: Column) -> Column:
    lens = F.transform(T.sentences(b), lambda s: F.size(T.spaced(s)).cast("double"))
    return F.coalesce(T.variance(lens), F.lit(0.0))


@metric("lexical_diversity")
def lexical_diversity(a: Column, b: Column) -> Column:
    return T.let(T.spaced(F.lower(b)), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.size(w)))


def missing_placeholders(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(found(a, PLACEHOLDER), found(b, PLACEHOLDER)))


def same_number(x: Column, y: Column) -> Column:
    """Equal as decimals and both or neither a percentage; numbers too long for a decimal must be equal as written."""
    as_decimal = lambda z: F.replace(z, F.lit("%"), F.lit("")).try_cast("decimal(38,18)")
    return (x.endswith("%") == y.endswith("%")) & F.coalesce(as_decimal(x) == as_decimal(y), x == y)


def missing_numbers(a: Column, b: Column) -> Column:
    others = found(F.regexp_replace(b, r"(\d)\s+%", "$1%"), NUMBER)
    lost = T.let(F.array_distinct(others), lambda o: F.filter(F.array_distinct(found(a, NUMBER)), lambda x: ~F.exists(o, lambda y: same_number(x, y))))
    return F.array_sort(lost)


def verification(a: Column, b: Column) -> Column:
    """Struct of passed, missing placeholders, missing numbers and the reason, null if it passed."""
    some = lambda text, items: F.when(F.size(items) > 0, F.concat(F.lit(text), F.array_join(items, ", ")))

    def of(x: Column) -> Column:
        reason = F.concat_ws("; ", some("missing placeholders: ", x["marks"]), some("missing numbers: ", x["numbers"]))
        return F.struct((reason == "").alias("passed"), x["marks"].alias("placeholders"), x["numbers"].alias("numbers"), F.when(reason != "", reason).alias("reason"))

    return T.let(F.struct(missing_placeholders(a, b).alias("marks"), missing_numbers(a, b).alias("numbers")), of)


@metric("term_preservation")
def term_preservation(a: Column, b: Column) -> Column:
    return verification(a, b)["passed"].cast("double")


def nli_score(forward: Column, backward: Column) -> Column:
    """Entailment both ways 1, forward only 0.5, any contradiction 0, else 0.25; the labels come from a model's column."""
    no = (forward == "contradiction") | (backward == "contradiction")
    return F.when(no, 0.0).when((forward == "entailment") & (backward == "entailment"), 1.0).when(forward == "entailment", 0.5).otherwise(0.25)


def tokens(text: Column) -> Column:
    return found(F.lower(text), TOKEN)


def with_jaccard(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the share of the distinct items of both columns that both hold; 1 if there are none. Each count stands in a column of its own."""
    df = df.withColumn("_both", F.size(F.array_intersect(a, b)))
    df = df.withColumn("_any", F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - F.col("_both"))
    return df.withColumn(name, F.when(F.col("_any") == 0, 1.0).otherwise(F.col("_both") / F.col("_any"))).drop("_both", "_any")


def overlaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the tokens of both texts (ta, tb) and their unigram and bigram overlaps. Tokens and bigrams are compared by 64-bit names, since
    sets of numbers take less than those of strings, and no bigram is written out."""
    df = df.withColumn("ta", tokens(F.col(a))).withColumn("tb", tokens(F.col(b)))
    df = df.withColumn("_one_a", T.hashed(F.col("ta"))).withColumn("_one_b", T.hashed(F.col("tb")))
    df = df.withColumn("_two_a", T.neighbours(F.col("_one_a"), F.col("_one_a"))).withColumn("_two_b", T.neighbours(F.col("_one_b"), F.col("_one_b")))
    df = with_jaccard(with_jaccard(df, "_one_a", "_one_b", "unigram_overlap"), "_two_a", "_two_b", "bigram_overlap")
    return df.drop("_one_a", "_one_b", "_two_a", "_two_b")


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in ("chars", "joined", "tokens")]))
def matched_shares(a: pa.Array, b: pa.Array, ta: pa.Array, tb: pa.Array) -> pa.Array:
    """Shares of matching characters, of characters of the joined tokens, and of tokens, from the texts and their joined tokens. The longest-match
    recursion has no column form. Rows become Python's strings one by one."""
    rows = ([v.as_py() for v in row] for row in zip(a, b, ta, tb))
    shares = [(matching.ratio(x.lower(), y.lower()), matching.ratio(p, q), matching.ratio(p.split(), q.split())) for x, y, p, q in rows]
    return pa.StructArray.from_arrays([pa.array([s[k] for s in shares], pa.float64()) for k in range(3)], ["chars", "joined", "tokens"])


def quick_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds quick_similarity: 1 for two texts without tokens, 0 if only one has some."""
    df = in_small_batches(overlaps(df, a, b))
    df = df.withColumn("_m", matched_shares(a, b, F.array_join("ta", " "), F.array_join("tb", " ")))
    blend = 0.28 * F.col("_m.chars") + 0.27 * F.col("_m.joined") + 0.18 * F.col("_m.tokens") + 0.17 * F.col("unigram_overlap") + 0.10 * F.col("bigram_overlap")
    both, one = (F.size("ta") == 0) & (F.size("tb") == 0), (F.size("ta") == 0) | (F.size("tb") == 0)
    either = (F.length(a) == 0) != (F.length(b) == 0)
    return df.withColumn("quick_similarity", F.when(either, 0.0).when(both, 1.0).when(one, 0.0).otherwise(blend)).drop("_m")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in [-1, 1]; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def token_f1(a: Column, b: Column) -> Column:
    """The F score of matched token vectors."""
    from loomtext.operators import alignment

    return alignment.matched(a, b)["f1"]


#: Metrics over other columns than the texts: what they need, and how they are computed from the originals' and the rewrites' column.
COLUMN_METRICS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "embedding_cosine": ("vectors", cosine), "nli_entailment": ("labels", nli_score), "bertscore": ("token_vectors", token_f1),
}


def registered() -> list[str]:
    """The names of all metrics."""
    return sorted([*METRICS, *COLUMN_METRICS])


def measured(df: DataFrame, names: list[str], a: str, b: str, **columns: tuple[str, str]) -> DataFrame:
    """Adds a column for each named metric. Those of COLUMN_METRICS take their pairs of columns by what they need: vectors=("va", "vb"),
    labels (entailment forward and backward) and token_vectors."""
    out = []
    for n in names:
        if n in METRICS:
            out.append(METRICS[n](F.col(a), F.col(b)).alias(n))
        elif n not in COLUMN_METRICS:
            raise ValueError(f"unknown metric {n}; there are {', '.join(registered())}")
        elif COLUMN_METRICS[n][0] not in columns:
            raise ValueError(f"metric {n} needs the columns {COLUMN_METRICS[n][0]}")
        else:
            needs, compute = COLUMN_METRICS[n]
            out.append(compute(*map(F.col, columns[needs])).alias(n))
    return df.select("*", *out)
