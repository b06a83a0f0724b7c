"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule `host/path` fits its host and all subdomains where the path starts with the rule's path. The trie walks a URL's host from
its last label and, at every label that ends a rule's host, the path by segments; the walk that gets furthest wins: more host
labels first, then more of the path. Of an allow and a block rule for the same host and path, the block rule wins.

The trie travels to the executors as a broadcast variable, up to MAX_RULES rules and MAX_BYTES of their texts. More rules are joined
with each URL's own host suffixes and path prefixes (`judge_by_join`), with the same result.

Cases: a null URL or one without `://` has an empty host and path and gets the default verdict; of equal rules the block rule wins;
repeated rows are judged each; URLs of any length are judged whole; an empty table gives an empty result; only the two named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import small

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
#: What is broadcast at most; a rule takes some 500 bytes in the trie besides its text.
MAX_RULES, MAX_BYTES = 100_000, 16 << 20
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL as the rules see them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for k in (rest.find("?"), rest.find("#")) if k >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(UPPER), slash + path


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """Label -> (deeper labels, path node); a path node maps segments to path nodes and None to {tail: (rule, verdict)}."""
    trie: dict = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        node, held = trie, {}
        for label in reversed(host.translate(UPPER).split(".")):
            node, held = node.setdefault(label, ({}, {}))
        *segments, tail = (slash + path).split("/")
        for segment in segments:
            held = held.setdefault(segment, {})
        tails = held.setdefault(None, {})
        if tails.get(tail, ("", ""))[1] != "block":
            tails[tail] = (rule, verdict)
    return trie


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        if label not in node:
            break
        node, paths = node[label]
        for segment in segments:
            tails = paths.get(None, {})
            best = next((tails[segment[:k]] for k in range(len(segment) if tails else -1, -1, -1) if segment[:k] in tails), best)
            paths = paths.get(segment)
            if paths is None:
                break
    return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of each row's url."""
    rules = list(rules)
    if len(rules) > MAX_RULES or sum(len(rule) for rule, _ in rules) > MAX_BYTES:
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "rule string, verdict string"), default, key)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [longest(trie.value, *x) or (None, default) for x in parts]
            columns = [[x[0] for x in parts], [x[1] for x in parts], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, "url").mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, key: str = "page_id") -> DataFrame:
    """The same for a table of rules (rule, verdict) of any size."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    has = F.locate("://", "url") > 0
    rest = F.regexp_extract(F.when(has, F.expr("substring(url, locate('://', url) + 3)")).otherwise(""), r"^([^?#]*)", 1)
    rows = pages.select(key, rest.alias("rest")).withColumn("n", F.monotonically_increasing_id())
    rows = rows.withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/]*)", 1), upper, lower)).withColumn("path", F.regexp_extract("rest", r"^[^/]*((?:/[\s\S]*)?)$", 1))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    # Only prefixes as long as some rule's path: a list no longer than the longest rule.
    lengths = F.array(*[F.lit(r.n) for r in rules.select(F.length(F.regexp_extract("rule", r"^[^/]*((?:/[\s\S]*)?)$", 1)).alias("n")).distinct().collect()]).cast("array<int>")
    prefix = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    keys = rows.select("n", "path", F.explode(suffix).alias("s"), F.lit(prefix).alias("p")).select("n", "s", F.explode("p").alias("p"))
    keys = keys.select("n", F.concat("s", "p").alias("k"), F.size(F.split("s", r"\.")).alias("labels"), F.length("p").alias("chars"))
    normal = F.concat(F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), upper, lower), F.regexp_extract("rule", r"^[^/]*((?:/[\s\S]*)?)$", 1))
    one = rules.withColumn("k", normal).groupBy("k").agg(F.max_by(F.struct("rule", "verdict"), F.col("verdict") == "block").alias("r"))
    one = F.broadcast(one) if small(one, MAX_RULES) else one
    best = keys.join(one, "k").groupBy("n").agg(F.max_by("r", F.struct("labels", "chars")).alias("r"))
    out = rows.join(best, "n", "left")
    return out.select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for op1_url_filter: every pair of URL and rule that fit, the longest kept."""
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    return f"""
with cut as (
  select page_id, url, regexp_extract(case when url like '%://%' then substr(url, position('://' in url) + 3) else '' end, '^([^?#]*)', 1) rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) path
  from cut),
rules(rule, rule_host, rule_path, rule_verdict) as (values {rules}),
fit as (
  select p.page_id, arg_max(rule, (len(string_split(rule_host, '.')), length(rule_path))) rule,
    arg_max(rule_verdict, (len(string_split(rule_host, '.')), length(rule_path))) rule_verdict
  from parts p join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  group by p.page_id)
select page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') verdict from parts left join fit using (page_id)"""
