"""Gated scorers, token matching, cross-perplexity, tags, trees and sentences by rules, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import features, scoring, signals, tags
from loomtext.functions import text as T
from loomtext.operators import alignment, tiers


def scorer_of_lengths(name, **options):
    """Functions inside a function travel to the workers, which cannot import this module."""

    def score(held, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [(len(t) / held["top"], "long" if len(t) > 5 else "short", {"n": float(len(t))}) for t in texts]

    return tiers.Scorer(name, lambda: {"top": 100.0}, score, **options)


def rows(spark):
    texts = ["one", None, "a longer text", "a bad one", "", "one", "the last text"]
    return spark.createDataFrame([(i, t, i % 2 == 0 if i < 6 else None) for i, t in enumerate(texts)], "id long, text string, inside boolean").repartition(3)


def test_scores_and_errors(spark):
    scorer = scorer_of_lengths("length", together=3)
    out = {r.id: r.length for r in tiers.scored(rows(spark), scorer).collect()}
    assert out[1] is None
    assert (out[2].score, out[2].label, out[2].features, out[2].error) == (0.13, "long", {"n": 13.0}, None)
    assert (out[3].score, out[3].label, out[3].error) == (None, None, "ValueError: bad text")
    assert out[0] == out[5] and out[4].score == 0.0
    assert tiers.scored(rows(spark).filter("id < 0"), scorer).count() == 0


@pytest.mark.parametrize("tasks", [None, 2])
def test_no_call_outside_the_gate(spark, tasks):
    calls, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return {"top": 1.0}

    def score(held, texts):
        if any(t.startswith("no") for t in texts):
            raise AssertionError("a text outside the gate was scored")
        return [(float(t.split()[1]), None, None) for t in texts]

    scorer = tiers.Scorer(f"gated{tasks}", load, score, together=7, counted=lambda n: calls.add(n))
    df = spark.createDataFrame([(i, f"{'yes' if i % 5 == 0 else 'no'} {i}") for i in range(500)], "id long, text string").repartition(4)
    gate = F.col("id") % 5 == 0
    out = tiers.scored(df, scorer, gate=gate) if tasks is None else tiers.dealt(df, scorer, tasks, gate=gate)
    got = {r.id: r[scorer.name] for r in out.collect()}
    assert len(got) == 500 and all((got[i] is None) == (i % 5 > 0) for i in got)
    assert all(got[i].score == i and got[i].error is None for i in range(0, 500, 5))
    assert calls.value == 100 and 1 <= loads.value <= 4


def test_models_are_made_once_and_dropped():
    made, closed = [], []

    class Model:
        def __init__(self, name):
            self.name = name
            made.append(name)

        def close(self):
            closed.append(self.name)

    first, second = (tiers.Scorer(n, lambda n=n: Model(n), lambda m, t: [], alone=n == "test second") for n in ("test first", "test second"))
    with pytest.raises(RuntimeError, match="not loaded"):
        tiers.loaded("test first")
    assert tiers.model(first) is tiers.model(first) is tiers.loaded("test first")
    tiers.model(second)  # drops the other one
    assert made == ["test first", "test second"] and closed == ["test first"]
    with pytest.raises(RuntimeError):
        tiers.loaded("test first")
    tiers.release("test second", "unknown")
    assert closed == ["test first", "test second"]


def test_tiers_follow_thresholds(spark):
    data = [(i, "x" * i, a, b) for i, (a, b) in enumerate([(0.1, 0.2), (0.5, 0.5), (0.5, None), (0.9, 0.9), (0.2, 0.3), (0.7, 0.65)])]
    df = spark.createDataFrame(data, "id long, text string, first_score double, stat_score double")
    scorer = tiers.Scorer("tier3", lambda: None, lambda m, texts: [(0.8, None, None) for _ in texts])
    out = {r.id: r for r in tiers.detected(df, scorer).collect()}
    assert [i for i in out if out[i].gated] == [1, 2]
    assert math.isclose(out[1].ensemble_score, 0.4 * 0.5 + 0.15 * 0.5 + 0.45 * 0.8) and math.isclose(out[2].ensemble_score, (0.4 * 0.5 + 0.45 * 0.8) / 0.85)
    assert [out[i].classification for i in range(6)] == ["human", "ambiguous", "ai_generated", "ai_generated", "human", "ai_generated"]
    assert all(r.gated for r in tiers.detected(df, scorer, always=True).collect())
    moved = {r.id: r for r in tiers.detected(df, scorer, human_max=0.05, ai_min=0.95).collect()}
    assert all(r.gated for r in moved.values()) and moved[0].classification == "ambiguous"


def test_records_agree_between_runs(spark):
    samples = rows(spark).select(F.col("id").cast("string").alias("sample_id"), "text")
    scorer = scorer_of_lengths("record")
    first, second = (sorted(map(str, tiers.detections(samples, scorer).collect())) for _ in range(2))
    assert first == second and len({r.record_id for r in tiers.detections(samples, scorer).collect()}) == 7


# Token matching


def plain_matching(ref, cand, rw, cw, baseline):
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] if v else None
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) if a and b else 0.0
    a, b = [unit(v) for v in ref], [unit(v) for v in cand]
    if not a or not b:
        return tuple((0 - x) / (1 - x) for x in baseline)
    p = sum(w * max(cos(x, y) for y in a) for x, w in zip(b, cw)) / sum(cw)
    r = sum(w * max(cos(x, y) for y in b) for x, w in zip(a, rw)) / sum(rw)
    return tuple((x - y) / (1 - y) for x, y in zip((p, r, 2 * p * r / (p + r) if p + r else 0.0), baseline))


def test_token_matching(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: rng.choice([[rng.uniform(-1, 1) for _ in range(5)]] * 6 + [[0.0] * 5, None])
    data = [(i, [vec() for _ in range(rng.randint(1, 9))], [vec() for _ in range(rng.randint(1, 9))]) for i in range(40)] + [(40, [], [vec()]), (41, [vec()], []), (42, [], [])]
    data = [(i, a, b, [rng.uniform(0.1, 2) for _ in a], [rng.uniform(0.1, 2) for _ in b]) for i, a, b in data] + [(43, None, [[1.0] * 5], [], [1.0])]
    df = spark.createDataFrame(data, "i long, a array<array<double>>, b array<array<double>>, wa array<double>, wb array<double>")
    base = (0.1, 0.2, 0.3)
    monkeypatch.setattr(alignment, "BLOCK", 3)
    got = df.select("i", alignment.matched(F.col("a"), F.col("b"), F.col("wa"), F.col("wb"), base).alias("w"), alignment.matched(F.col("a"), F.col("b")).alias("p")).collect()
    for r, (i, a, b, wa, wb) in zip(sorted(got), data):
        if a is None:
            assert r.w is None and r.p is None
            continue
        assert np.allclose(tuple(r.w), plain_matching(a, b, wa, wb, base)), i
        assert np.allclose(tuple(r.p), plain_matching(a, b, [1] * len(a), [1] * len(b), (0, 0, 0))), i


@pytest.mark.parametrize("bound", [1000, 3])
def test_weights_from_a_corpus(spark, monkeypatch, bound):
    monkeypatch.setattr(alignment, "TOKENS_BROADCAST", bound)
    data = [(1, [1, 2, 2, 3]), (2, [2, 4]), (3, []), (None, [2, 9]), (5, None)]
    df = spark.createDataFrame(data, "k long, ids array<int>")
    table, n = alignment.idf(df.filter("k < 4"), "ids")
    holds = Counter(t for k, ids in data if k and k < 4 for t in set(ids))
    assert n == 3 and {r.token: round(r.weight, 9) for r in table.collect()} == {t: round(math.log(4 / (c + 1)), 9) for t, c in holds.items()}
    got = {r.k: r.w for r in alignment.with_idf(df, table, n, ["k"], "ids", "w").collect()}
    for k, ids in data:
        if ids:
            assert np.allclose(got[k], [math.log(4 / (holds[t] + 1)) for t in ids])
    assert not got[3] and not got[5]


# Cross-perplexity


def test_cross_perplexity(spark):
    rng = np.random.default_rng(5)
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    data = []
    for k in range(30):
        n, v = int(rng.integers(2, 9)), int(rng.integers(2, 12))
        data.append((k, rng.normal(0, 30, (n, v)).tolist(), rng.normal(0, 30, (n, v)).tolist(), rng.integers(0, v, n).tolist()))
    data += [(30, [[1.0, 2.0]], [[1.0, 2.0]], [1]), (31, [], [], []), (32, [[0.0, 0.0]] * 3, [None, [0.0, 0.0], [0.0]], [0, 1, 1]), (33, [[5.0], [5.0]], [[1.0], [1.0]], [0, 0]), (34, [[1.0, 2.0]] * 2, [[1.0, 2.0]] * 2, [0, 7]), (35, None, [], [])]
    df = spark.createDataFrame(data, "k long, o array<array<double>>, q array<array<double>>, ids array<int>")
    got = {r.k: r.x for r in df.select("k", signals.cross_perplexity(F.col("o"), F.col("q"), F.col("ids")).alias("x")).collect()}
    for k, o, q, ids in data[:30]:
        own = cross = 0.0
        for i in range(len(ids) - 1):
            logs = np.array(o[i]) - max(o[i]) - np.log(np.exp(np.array(o[i]) - max(o[i])).sum())
            own -= logs[ids[i + 1]]
            cross -= softmax(np.array(q[i])) @ logs
        assert math.isclose(got[k], own / cross, rel_tol=1e-9), k
    assert [got[k] for k in range(30, 36)] == [None, None, 1.0, 1.0, None, None]  # 32: the second position alone, uniform in both


# Tags and trees


def test_tags_and_trees(spark):
    rng = random.Random(7)
    data = []
    for k in range(60):
        words, sizes = [], [rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        for s, size in enumerate(sizes):
            base = len(words)
            for i in range(size):
                head = base + i if i == 0 else base + rng.randrange(i) if k % 2 else base + i - 1
                words.append((rng.choice(["VERB", "AUX", "NOUN", None]), "ROOT" if i == 0 else rng.choice(["conj", "advcl", "obj", None]), head, s))
        data.append((k, [w[0] for w in words], [w[1] for w in words], [w[2] for w in words], [w[3] for w in words]))
    df = spark.createDataFrame(data, "k long, t array<string>, r array<string>, h array<int>, s array<int>")
    got = {r.k: r for r in df.select("k", tags.tag_entropy(F.col("t")).alias("e"), tags.clause_density(F.col("t"), F.col("r"), F.col("h")).alias("c"), tags.roots(F.col("h")).alias("roots")).collect()}
    for k, t, r, h, s in data:
        runs = Counter(zip(t, t[1:], t[2:]))
        total = sum(runs.values())
        if len(t) < 3:
            assert got[k].e is None
        else:
            assert math.isclose(got[k].e, -sum(c / total * math.log2(c / total) for c in runs.values()), abs_tol=1e-9)
        assert [s[x] for x in got[k].roots] == s and all(h[x] == x for x in got[k].roots)
        counts = [sum(a in tags.CLAUSE_TAGS and b in tags.CLAUSE_RELATIONS for a, b, x in zip(t, r, s) if x == n) for n in sorted(set(s))]
        if len(counts) < 3:
            assert got[k].c is None
        else:
            assert math.isclose(got[k].c.mean, np.mean(counts)) and math.isclose(got[k].c.variance, np.var(counts), abs_tol=1e-12)


def test_heads_that_are_none(spark):
    df = spark.createDataFrame([([None, 0, 99, -1, 2],)], "h array<int>")
    assert df.select(tags.roots(F.col("h")).alias("r")).first().r == [0, 0, 2, 3, 2]


def test_all_fifteen_features_score(spark):
    n = 60
    words = " ".join(("the" if i % 5 == 0 else f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}") + ("." if i % 12 == 11 else "") for i in range(n))
    row = (words, ["VERB"] * n, ["ROOT"] + ["conj"] * (n - 1), [i // 12 * 12 for i in range(n)], [3.0, 4.0, 5.0], [20, 20, 20], [-1.0, -2.0, -8.0])
    df = spark.createDataFrame([row], "text string, tags array<string>, rel array<string>, head array<int>, losses array<double>, n array<int>, lp array<double>")
    out = features.stat_score(df, tag="tags", relation="rel", head="head", losses="losses", loss_tokens="n", log_probs="lp").first()
    there = [out[name] for name in features.SCORED]
    assert len(there) == 15 and all(x is not None for x in there) and 0 <= out.stat_score <= 1
    assert (out.lm_perplexity_mean, round(out.disc_pos_trigram_entropy, 9), out.style_clause_density_variance) == (4.0, 0.0, 0.0)


# Sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Pi is 3.14 and e.g. tau is 6.28. Next one.", ["Pi is 3.14 and e.g. tau is 6.28.", "Next one."]),
        ("Dr. Smith met J. Doe in the U.S. today. (They spoke.) “Why?” he asked.", ["Dr. Smith met J. Doe in the U.S. today.", "(They spoke.)", "“Why?”", "he asked."]),
        ("Wait... what?! Yes. ", ["Wait... what?!", "Yes."]),
        ("It ends here.Then it goes on. v1.Two", ["It ends here.", "Then it goes on.", "v1.Two"]),
        ('She said "stop." Then left! No end', ['She said "stop."', "Then left!", "No end"]),
        ("see fig. 2, vol. 3 etc. for more. \x01\x02 kept. ", ["see fig. 2, vol. 3 etc. for more.", "\x01\x02 kept."]),
        ("", []), ("  \n ", []), ("no stop", ["no stop"]),
    ],
)
def test_sentences_by_rules(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tags.rule_sentences(F.col("t")).alias("s")).first().s == want


def test_pieces_are_the_text(spark):
    rng = random.Random(9)
    some = ["".join(rng.choice(["a", "B", ".", "!", "?", " ", "\n", "\x01", "\x02", "\x03", '"', ")", "e.g.", "Mr.", "3.1", "…", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    for r in df.select("t", tags.sentence_pieces(F.col("t")).alias("p")).collect():
        assert "".join(r.p) == r.t and "" not in r.p


def test_gate_is_strict(spark):
    df = spark.createDataFrame([(0.25, 0.25), (0.5, 0.5), (0.75, 0.75), (0.5, None), (None, None)], "s double, t double")
    of = lambda **k: [r.g for r in df.select(scoring.needs_third_tier(F.col("s"), F.col("t"), **k).alias("g")).collect()]
    assert of(human_max=0.3, ai_min=0.7) == [False, True, False, True, None]
    assert of(human_max=0.5, ai_min=0.9)[1] is False
    assert of(always=True) == [True] * 5


def test_multiplicities(spark):
    rows = [([],), ([5],), ([1, 1, 1],), ([1, 2, 2, 3, 3, 3, -4][::-1],), (None,)]
    df = spark.createDataFrame(rows, "v array<long>").select(T.multiplicities(F.sort_array("v")).alias("n"))
    got = [r.n for r in df.collect()]
    assert got[:4] == [[], [1], [3], [1, 1, 2, 3]] and not got[4]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tag_sorts_stand_in_columns_of_their_own(spark):
    """Inside a lambda Spark sorts boxed numbers."""
    docs = spark.createDataFrame([(["x"] * 9, ["NOUN", "VERB", "AUX"] * 3, ["ROOT", "obj", "conj"] * 3, [0, 0, 1] * 3)], "words array<string>, tags array<string>, rels array<string>, heads array<int>")
    out = features.tagged(docs, "tags", "rels", "heads")
    assert "AS _runs#" in plan_of(out) and "AS _places#" in plan_of(out)
    row = out.first()
    assert row.disc_pos_trigram_entropy == pytest.approx(-sum(c / 7 * math.log2(c / 7) for c in (3, 2, 2)))
    assert row.clause_density_mean is None


def test_tail_ratio_takes_no_moments(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -9.0, -3.0],), ([-1.0],), (None,)], "v array<double>")
    out = features.modelled(df, log_probs="v")
    assert "power(" not in plan_of(out).lower()
    assert [r.lm_token_prob_tail_ratio for r in out.collect()] == [0.25, None, None]


def test_words_are_looked_for_once(spark):
    """The words of a text are those of its sentences: one pass of the pattern, with the same words as over the whole text."""
    texts = ["One two. Three3 four!five 5six?", "a.b..c 3.5x y", "", None, "No end", "...", "É.à l'été, x2y. \n\nZ"]
    df = features.with_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    plan = plan_of(df.select("words", "lens"))
    assert plan.count("regexp_extract_all") == 1
    whole = df.select("words", T.words(F.coalesce("text", F.lit(""))).alias("want")).collect()
    assert all(r.words == r.want for r in whole) and whole[0].words == ["one", "two", "four", "five"]
