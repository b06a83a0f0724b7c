"""Similarity of whole documents against a plain version."""

import random
import re
import time
from difflib import SequenceMatcher
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from loomtext.functions import matching, pairs
from loomtext.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(a, b):
    if not a or not b:
        return float(a == b)
    x, y = (re.findall(r"\[(?:MATH|TERM)_\d{3}\]|\d+(?:\.\d+)?%?|[a-z]+(?:-[a-z]+)*", t.lower()) for t in (a, b))
    if not x or not y:
        return float(x == y)
    ratio = lambda p, q: SequenceMatcher(None, p, q).ratio()
    jaccard = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
    overlap = 0.17 * jaccard(set(x), set(y)) + 0.10 * jaccard(set(pairwise(x)), set(pairwise(y)))
    return 0.28 * ratio(a.lower(), b.lower()) + 0.27 * ratio(" ".join(x), " ".join(y)) + 0.18 * ratio(x, y) + overlap


def test_documents_whole(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.quick_similarity for r in catalogue.queries()["quick_similarity_documents"](spark, SF).collect()}
    want = {i: plain(t, texts[i + 1]) for i, t in texts.items() if i + 1 in texts}
    assert got == pytest.approx(want, abs=2e-6)


def test_shares_equal_the_standard_library(monkeypatch):
    """Both ways, over texts and lists below and above the size from which frequent items begin no match."""
    draw = random.Random(5)
    for k in range(400):
        letters = draw.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz0123456789 é\U0001f600"])
        a = "".join(draw.choices(letters, k=draw.randint(0, 400)))
        b = "".join(draw.choices(letters, k=draw.randint(0, 400)))
        if k % 2:
            b = "".join(x if draw.random() < 0.9 else draw.choice(letters) for x in a) + a[: draw.randint(0, 99)]
        monkeypatch.setattr(matching, "LARGE", draw.choice([0, 5_000, 3_000_000]))
        for x, y in ((a, b), (list(a), list(b))):
            assert matching.ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_long_texts_take_less_than_the_square():
    """The standard library takes minutes for these, as the recursion looks at all pairs of equal characters."""
    draw = random.Random(7)
    letters = "".join(chr(0x4E00 + i) for i in range(150))
    a, b = ("".join(draw.choices(letters, k=150_000)) for _ in range(2))
    start = time.monotonic()
    assert 0 < matching.ratio(a, b) < 1
    assert time.monotonic() - start < 30


def test_overlaps_write_no_bigrams(spark):
    """Bigrams and tokens are compared by numbers."""
    rows = [("a b a b c", "b a b 2.5%"), ("", ""), ("a", ""), ("x y", "x y"), ("only", "only")]
    out = pairs.overlaps(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan and "xxhash64" in plan
    got = [(r.unigram_overlap, r.bigram_overlap) for r in out.collect()]
    assert got == [(2 / 4, 2 / 4), (1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)]


def test_python_gets_few_rows_at_once(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "10000")
        sizes = spark.range(5_000, numPartitions=1).select(F.concat(F.lit("some text "), F.col("id")).alias("a"), F.lit("some text 7").alias("b"))
        out = pairs.quick_similarity(sizes, "a", "b")
        assert spark.conf.get(rows) == "1000" and out.filter("quick_similarity = 1").count() == 1
    finally:
        spark.conf.set(rows, before)
