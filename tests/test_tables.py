"""Progress that can be saved twice, records by type, spans, nearest sizes, line numbers and chunkers, against plain versions and fixtures."""

import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.operators import chunks, markup, nearest, protect, spans
from loomtext.sources import files, progress, records


# Progress


def results(spark, rows):
    return spark.createDataFrame(rows, "digest string, chunk_id string, score double")


def loaded(spark, path, docs, stage="detecting"):
    return {(r.digest, r.chunk_id): json.loads(r.result)["score"] for r in progress.load(spark, path, docs, stage).collect()}


def test_a_batch_twice_leaves_one_row(spark, tmp_path):
    path = f"file://{tmp_path}/progress"
    docs = spark.createDataFrame([("a",), ("b",)], "digest string")
    assert not progress.exists(spark, path) and loaded(spark, path, docs) == {}
    for _ in range(2):
        progress.save(results(spark, [("a", "1", 0.1), ("b", "2", 0.2)]), path, "detecting", 0)
    progress.save(results(spark, [("a", "1", 0.3), ("old", "3", 0.9)]), path, "detecting", 1)
    progress.save(results(spark, [("a", "1", 0.7)]), path, "evaluating")
    assert progress.batches(spark, path, "detecting") == [0, 1]
    assert loaded(spark, path, docs) == {("a", "1"): 0.3, ("b", "2"): 0.2}
    assert progress.exists(spark, path, "detecting") and not progress.exists(spark, path, "other")
    assert progress.compact(spark, path) == 4
    want = {("a", "1"): 0.3, ("b", "2"): 0.2}
    assert loaded(spark, path, docs) == want and loaded(spark, path, docs, "evaluating") == {("a", "1"): 0.7}
    progress.save(results(spark, [("a", "1", 0.1), ("b", "2", 0.2)]), path, "detecting", 0)  # given again after all
    assert loaded(spark, path, docs) == want
    progress.save(results(spark, [("b", "2", 0.5)]), path, "detecting")
    assert loaded(spark, path, docs) == {**want, ("b", "2"): 0.5}
    # A compaction that did not end is not read.
    Path(tmp_path, "progress/generation=9/stage=detecting").mkdir(parents=True)
    assert loaded(spark, path, docs) == {**want, ("b", "2"): 0.5}
    assert progress.compact(spark, path) == 4 and loaded(spark, path, docs) == {**want, ("b", "2"): 0.5}
    progress.clear(spark, path)
    assert not progress.exists(spark, path) and loaded(spark, path, docs) == {}


def test_progress_of_a_stream(spark, tmp_path):
    path, source = f"file://{tmp_path}/progress", f"{tmp_path}/in"
    docs = spark.createDataFrame([("a",), ("b",)], "digest string")
    for score in (0.1, 0.2):
        results(spark, [("a", "1", score), ("b", "2", score)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("digest string, chunk_id string, score double").parquet(source)
        progress.save_stream(stream, path, "detecting", f"{tmp_path}/check").awaitTermination()
    assert progress.batches(spark, path, "detecting") == [0, 1]
    assert loaded(spark, path, docs) == {("a", "1"): 0.2, ("b", "2"): 0.2}


# Records


def test_records_round_trip(spark):
    rows = [
        {"record_class": "ProseChunk", "id": "1", "text": "a \"b\" é", "chunk_type": "prose", "start_pos": 0, "end_pos": 9, "metadata": {"k": "v"}, "math_placeholders": {"[MATH_001]": "$x$"}, "term_placeholders": {}, "protected_text": "p", "domain_hint": "stem", "raw_content": None},
        {"record_class": "StructuralChunk", "id": "2", "text": "t", "chunk_type": "structural", "start_pos": 9, "end_pos": 9, "metadata": {}, "math_placeholders": None, "term_placeholders": None, "protected_text": None, "domain_hint": None, "raw_content": "raw\n"},
        {"record_class": "Chunk", "id": "3", "text": "", "chunk_type": "structural", "start_pos": 1, "end_pos": 2**40, "metadata": {}, "math_placeholders": None, "term_placeholders": None, "protected_text": None, "domain_hint": None, "raw_content": None},
    ]
    schema = "record_class string, " + ", ".join(f"{n} {t}" for n, t in records.FIELDS.items())
    df = spark.createDataFrame([(r,) for r in rows], f"r struct<{schema.replace(' string', ':string').replace(' bigint', ':bigint').replace(' map', ':map')}>")
    out = records.decoded(df.select(records.encoded(F.col("r")).alias("json")), "json").collect()
    assert [r.record.asDict(recursive=True) for r in out] == rows
    assert json.loads(out[1].json)["_class"] == "StructuralChunk" and "protected_text" not in json.loads(out[1].json)


@pytest.mark.parametrize(
    ("given", "want", "problem"),
    [
        ({"_class": "ProseChunk", "id": "1", "text": "t", "chunk_type": "structural", "start_pos": 0, "end_pos": 1}, {"record_class": "ProseChunk", "chunk_type": "prose", "protected_text": "t", "domain_hint": "", "math_placeholders": {}, "raw_content": None}, None),
        ({"_class": "StructuralChunk", "id": "1", "text": "t", "chunk_type": "structural", "start_pos": 0, "end_pos": 1}, {"raw_content": "t", "metadata": {}, "protected_text": None}, None),
        ({"_class": "Other", "id": "1", "text": "t", "chunk_type": "prose", "start_pos": 0, "end_pos": 1}, {"record_class": "Chunk", "raw_content": None}, None),
        ({"id": "1", "text": "t", "chunk_type": "prose", "start_pos": 5, "end_pos": 1}, None, "end_pos 1 lies before start_pos 5"),
        ({"id": "1", "text": "t", "chunk_type": "prose", "start_pos": -1, "end_pos": 1}, None, "start_pos -1 is negative"),
        ({"id": "1", "chunk_type": "prose", "end_pos": 1}, None, "missing: text, start_pos"),
        ({"id": "1", "text": "t", "chunk_type": "verse", "start_pos": 0, "end_pos": 1}, None, "unknown chunk_type: verse"),
        ("no json", None, "missing: id, text, chunk_type, start_pos, end_pos"),
    ],
)
def test_records_are_checked(spark, given, want, problem):
    df = spark.createDataFrame([(given if isinstance(given, str) else json.dumps(given),)], "j string")
    r = records.decoded(df, "j", strict=False).first()
    assert r.record_problem == problem
    if want is None:
        assert r.record is None
        with pytest.raises(Exception, match="bad record"):
            records.decoded(df, "j").collect()
    else:
        assert {k: r.record[k] for k in want} == want


# Spans


def some_spans(rng, n, size):
    return [(rng.choice("ab"), s := rng.randrange(size), s + rng.choice((0, 1, 3, 40, 300)), rng.randrange(3)) for _ in range(n)]


@pytest.mark.parametrize("width", [7, 256])
def test_overlaps(spark, width):
    rng = random.Random(1)
    a, b = some_spans(rng, 80, 500), some_spans(rng, 80, 500)
    left, right = (spark.createDataFrame(x, "k string, start int, end int, rank int") for x in (a, b))
    got = sorted((tuple(r.left), tuple(r.right)) for r in spans.overlaps(left, right, "k", width=width).collect())
    assert got == sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])


def test_chosen_spans(spark):
    rng = random.Random(2)
    data = sorted(set(some_spans(rng, 120, 600)))
    want, taken = [], {}
    for k, start, end, rank in sorted(data, key=lambda x: (x[3], x[1], x[2])):
        if start < end and all(end <= s or e <= start for s, e in taken.setdefault(k, [])):
            taken[k].append((start, end))
            want.append((k, start, end, rank))
    df = spark.createDataFrame(data, "k string, start int, end int, rank int")
    assert sorted(map(tuple, spans.chosen(df, "k").collect())) == sorted(want)
    assert spans.chosen(df.filter("start < 0"), "k").count() == 0
    chain = spark.createDataFrame([("c", i, i + 2, 0) for i in range(30)], df.schema)  # each one waits for the one before
    assert sorted(r.start for r in spans.chosen(chain, "k").collect()) == list(range(0, 30, 2))


def test_entities_are_protected_at_their_rank(spark):
    text = "In (Miller, 2020) Acme Corp. sold 42 gizmos in Paris."
    place = lambda x: (text.index(x), text.index(x) + len(x))
    found = [(1, *place("Acme Corp."), "ORG"), (1, *place("Paris"), "GPE"), (1, *place("42"), "CARDINAL"), (1, *place("Miller, 2020"), "PERSON"), (1, *place("a"), "ORG"), (2, 0, 2, "ORG")]
    docs = spark.createDataFrame([(1, text), (3, "nothing")], "id long, text string")
    out = protect.with_entities(docs, spark.createDataFrame(found, "id long, start int, end int, label string"), "id")
    rows = {r.id: r.p for r in out.select("id", protect.protect(F.col("text"), ("gizmos",), entities=F.col("entities")).alias("p")).collect()}
    assert set(rows[1].terms.values()) == {"(Miller, 2020)", "Acme Corp.", "42", "gizmos", "Paris"}
    assert rows[3].terms == {} and rows[3].text == "nothing"
    back = rows[1].text
    for name, value in rows[1].terms.items():
        back = back.replace(name, value)
    assert back == text


# Nearest sizes


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_nearest(spark, ranges):
    rng = random.Random(3)
    family = lambda: rng.choice(["x", "x", "x", "y", None])
    offers = [(family(), float(rng.randrange(60)), f"o{i}") for i in range(60)] + [("x", None, "none"), ("z", 5.0, "z1"), ("z", 5.0, "z0")]
    asks = [(family(), rng.choice([float(rng.randrange(80)), rng.random() * 60]), f"o{rng.randrange(300)}") for _ in range(120)] + [("x", None, "q"), ("x", 0.0, "q"), ("w", 1.0, "q"), ("z", 9.0, "q")] * 2
    got = nearest.resolved(spark.createDataFrame(asks, "family string, size double, name string"), spark.createDataFrame(offers, "family string, size double, name string"), ranges)
    want = []
    for f, size, name in asks:
        mine = [(s, n) for g, s, n in offers if g == f]
        sized = [(s, n) for s, n in mine if s is not None]
        if any(n == name for _, n in mine):
            want.append((f, size, name, (name, next(s for s, n in mine if n == name), "name")))
        elif size and size > 0 and sized:
            s, n = min(sized, key=lambda x: (abs(x[0] - size), x[0], x[1]))
            want.append((f, size, name, (n, s, "size")))
        elif mine:
            top = max(s for s, _ in sized)
            want.append((f, size, name, (min(n for s, n in sized if s == top), top, "largest")))
        else:
            want.append((f, size, name, None))
    assert sorted(((r.family, r.size, r.name, r.found and tuple(r.found)) for r in got.collect()), key=str) == sorted(want, key=str)


# Lines


def test_bad_lines_are_named(spark, tmp_path):
    good = {"sample_id": "1", "split": "test", "domain": "d", "source_class": "human", "source_model": None, "document_format": "markdown", "text": "t" * 50, "metadata": {}}
    lines = [json.dumps(good | {"sample_id": str(i)}) for i in range(400)]
    lines[7], lines[200], lines[399] = '{"sample_id": ', json.dumps(good | {"split": "tset"}), json.dumps(good | {"source_class": None})
    lines[50] = "   "
    Path(tmp_path, "one.jsonl").write_text("\n".join(lines) + "\n")
    Path(tmp_path, "two.jsonl").write_text("\n\n" + json.dumps(good) + "\nnot json")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        found = files.jsonl_errors(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 1
        got = sorted((r.path.rpartition("/")[2], r.line, r.reason) for r in found.collect())
        assert got == [("one.jsonl", 8, "invalid JSON or type"), ("one.jsonl", 201, "bad split: tset"), ("one.jsonl", 400, "bad source_class: null"), ("two.jsonl", 4, "invalid JSON or type")]
        with pytest.raises(ValueError, match="one.jsonl line 8: invalid JSON"):
            files.verified_jsonl(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    Path(tmp_path, "one.jsonl").unlink()
    Path(tmp_path, "two.jsonl").write_text(json.dumps(good) + "\n\n")
    assert files.verified_jsonl(spark, str(tmp_path)).count() == 1 and files.jsonl_errors(spark, str(tmp_path)).count() == 0


# Chunkers

P, S = "prose", "structural"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Title\n=====\nbody", [(P, 0, 2), (P, 2, 3)]),
        ("a\nb\n---\nc\n***\n", [(P, 0, 3), (P, 3, 4), (S, 4, 5)]),
        ("Paragraph above.\n\n---\n\nParagraph below.\n", [(P, 0, 1), (S, 2, 3), (P, 4, 5)]),
        ("[x]: http://e.x \"t\"\n[y]: <a b>\ntext here", [(P, 2, 3)]),
        ("[x]:\n/url\n'title\nmore'\n\nq", [(P, 5, 6)]),
        ("[x] no: definition\n", [(P, 0, 1)]),
        ("<script>\nvar a;\n\nif (b) c;\n</script>\nprose", [(S, 0, 5), (P, 5, 6)]),
        ("<!-- a\n\nb -->\nz", [(S, 0, 3), (P, 3, 4)]),
        ("<?php\n\n?> rest\nz\n\n<![CDATA[\n\n]]>\n<!X\n>\n", [(S, 0, 3), (P, 3, 4), (S, 5, 8), (S, 8, 10)]),
        ("para\n<div>\nx\n\nend", [(P, 0, 1), (S, 1, 3), (P, 4, 5)]),
        ("<b>hi</b> there\nmore", [(P, 0, 2)]),
        ("<b class='x'>\nx\n\ny\n<b>\nz", [(S, 0, 2), (P, 3, 6)]),
        ("<pre>no end\n\nx", [(S, 0, 3)]),
        ("text\n2. no list\n1. list\n", [(P, 0, 2), (P, 2, 3)]),
        ("![a](b.png)\n\ntext", [(S, 0, 1), (P, 2, 3)]),
        ("", []), (" \n\n", []),
    ],
)
def test_markdown_blocks(text, want):
    assert [(kind, start, end) for _, kind, start, end, _, _ in markup.markdown_chunks(text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("text {group} end", [(P, "text"), (P, "group"), (P, "end")]),
        ("a % c\nb", [(P, "a"), (S, "% c"), (P, "b")]),
        ("\\begin{itemize}\\item one \\item[x] two\\end{itemize}", [(S, "\\item"), (P, "one"), (S, "\\item[x]"), (P, "two")]),
        ("% \\begin{document}\n\\documentclass{a}\n\\begin{document}\nreal\n\\end{document}", [(S, "% \\begin{document}\n\\documentclass{a}\n"), (P, "real")]),
        ("\\begin{document}a\\begin{verbatim}x\\end{document}\\end{verbatim} b % \\end{document}\n c\\end{document} no", [(P, "a"), (S, "\\begin{verbatim}x\\end{document}\\end{verbatim}"), (P, "b"), (S, "% \\end{document}"), (P, "c")]),
        ("Created by \\textbf{K {S} J} and \\emph{more} in \\verb|%| 100\\% ok.", [(P, "Created by \\textbf{K {S} J} and \\emph{more} in \\verb|%| 100\\% ok.")]),
        ("\\documentclass{article}\n\\begin{document}\n\\begin{unknownenv}\nContent.\n\\end{unknownenv}\n\\end{document}\n", [(S, "\\documentclass{article}\n"), (S, "\\begin{unknownenv}\nContent.\n\\end{unknownenv}")]),
        ("\\documentclass{article}\n\\begin{document}\n  \n  \n\\end{document}\n", [(S, "\\documentclass{article}\n")]),
        ("\\begin{align}a\\begin{align}b\\end{align}% \\end{align}\nc\\end{align} d", [(S, "\\begin{align}a\\begin{align}b\\end{align}% \\end{align}\nc\\end{align}"), (P, "d")]),
        ("{a {b} c} d", [(P, "a"), (P, "b"), (P, "c"), (P, "d")]),
        ("", []),
    ],
)
def test_latex_chunks(text, want):
    got = list(markup.latex_chunks(text))
    assert [(kind, body) for _, kind, _, _, body, _ in got] == want
    assert all(text[start:end] == body for _, _, start, end, body, _ in got)


def test_many_paragraphs(spark):
    """More parts than one running sum takes at once."""
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bé", " ", ""]) + "\n" * rng.randint(1, 4) for _ in range(1500))
    df = spark.createDataFrame([(text,), ("",), (None,), ("\n\n\nx",), ("x\n\n",)], "t string")
    got = [r.p for r in df.select(chunks.paragraphs(F.col("t")).alias("p")).collect()]
    assert got[2] is None
    for t, rows in zip((text, "", "\n\n\nx", "x\n\n"), (got[0], got[1], got[3], got[4])):
        assert all(t[r.start : r.end] == r.text for r in rows) and [r.pos for r in rows] == list(range(len(rows)))
    import re

    assert [r.text for r in got[0]] == [p for p in re.split("\n\n+", text) if p.strip()]


# Small pieces


def test_custom_environments(spark):
    from loomtext.operators import documents

    text = "\\documentclass{a}\\begin{document}\\begin{mine}Own prose.\\end{mine}\\keep{x} tail\\end{document}"
    docs = spark.createDataFrame([(1, "latex", text)], "id long, format string, text string")
    kinds = lambda **k: [(r.kind, r.text) for r in documents.parsed(docs, "id", **k).orderBy("pos").collect()]
    assert kinds()[1:] == [(S, "\\begin{mine}Own prose.\\end{mine}"), (P, "\\keep{x} tail")]
    assert kinds(prose_envs=("mine",), structural_macros=("keep",))[1:] == [(P, "Own prose."), (S, "\\keep{x}"), (P, "tail")]
    assert documents.prose(documents.parsed(docs, "id")).count() == 1


def test_latest_file(spark, tmp_path):
    with pytest.raises(ValueError, match="no"):
        files.latest(spark, f"file://{tmp_path}")
    for name in ("20250101-a.json", "20260226-b.json", "20240101-z.json", "20270101-x.txt"):
        Path(tmp_path, name).write_text("{}")
    assert files.latest(spark, f"file://{tmp_path}").endswith("20260226-b.json")


def test_summary_and_profiles(spark):
    from loomtext.operators import cascade

    rows = [("a", True, 0.9, "entailment"), ("a", False, 0.5, "neutral"), ("a", False, None, None), (None, True, 0.7, "entailment")]
    df = spark.createDataFrame(rows, "k string, passed boolean, similarity double, nli_forward string")
    out = {r.k: r for r in cascade.evaluation_summary(df, "k").collect()}
    assert (out["a"].n, round(out["a"].pass_rate, 3), out["a"].similarity_min, out["a"].labels) == (3, 0.333, 0.5, {"entailment": 1, "neutral": 1})
    assert (out[None].pass_rate, out[None].labels) == (1.0, {"entailment": 1})
    assert cascade.evaluation_summary(df).first().n == 4
    full = spark.createDataFrame([(None, 0.9, "entailment", "entailment", 0.5)], "term_reason string, similarity double, nli_forward string, nli_backward string, bertscore_f1 double")
    assert cascade.evaluated_for(full, "balanced", 0.88).first().passed and not cascade.evaluated_for(full, "quality", 0.88).first().passed
    with pytest.raises(ValueError, match="unknown profile"):
        cascade.evaluated_for(full, "best", 0.88)


def test_gates_and_originals(spark):
    from loomtext.operators import cascade

    df = spark.createDataFrame([("plain", 0.1), ("plain", 0.5), ("plain", 0.9), ("Please  NOTE that\nyour instructions matter", 0.9)], "t string, s double")
    assert [r.g for r in df.select(cascade.gate(F.col("t"), F.col("s"), 0.3, 0.65).alias("g")).collect()] == ["hard_floor", "semantic_gate", None, "prompt_echo"]
    cases = [((0, 1, 220, 0, False), True), ((0, 1, 221, 0, False), False), ((5, 0, 999, 0, False), True), ((0, 0, 999, 5, False), True), ((0, 0, 999, 1, True), True), ((0, 0, 999, 0, True), False), ((4, 0, 10, 4, False), False)]
    for (placeholders, math, length, failures, aborted), want in cases:
        assert spark.range(1).select(cascade.keeps_original(*map(F.lit, (placeholders, math, length, failures, aborted))).alias("k")).first().k is want


def test_column_metrics(spark):
    from loomtext.functions import pairs

    df = spark.createDataFrame([("a 1", "a 2", [1.0, 0.0], [1.0, 1.0], "entailment", "neutral", [[1.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]])], "a string, b string, va array<double>, vb array<double>, f string, g string, ta array<array<double>>, tb array<array<double>>")
    assert len(pairs.registered()) == 10 and pairs.registered() == sorted(pairs.registered())
    r = pairs.measured(df, pairs.registered(), "a", "b", vectors=("va", "vb"), labels=("f", "g"), token_vectors=("ta", "tb")).first()
    assert (round(r.embedding_cosine, 6), r.nli_entailment, round(r.bertscore, 6)) == (0.707107, 0.5, 0.666667)
    with pytest.raises(ValueError, match="needs the columns vectors"):
        pairs.measured(df, ["embedding_cosine"], "a", "b")
    with pytest.raises(ValueError, match="unknown metric"):
        pairs.measured(df, ["nothing"], "a", "b")


def test_confidence_and_version(spark):
    from loomtext.functions import signals
    from loomtext.sources.settings import Calibration

    df = spark.createDataFrame([(0.5,), (0.9,)], "score double")
    out = signals.with_confidence(df, Calibration("temperature_scaling", "v2", {"temperature": 2.0})).orderBy("score").collect()
    assert [round(r.confidence, 4) for r in out] == [0.5, 0.75] and {r.calibration_version for r in out} == {"v2"}


def test_members_get_their_groups_results(spark):
    groups = spark.createDataFrame([(1, 1, [0, 1]), (1, 2, [3]), (2, 1, [5])], "doc long, group_no long, members array<int>")
    found = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "doc long, group_no long, score double")
    got = sorted((r.doc, r.pos, r.score) for r in chunks.fanned_out(groups, found, "doc").collect())
    assert got == [(1, 0, 0.5), (1, 1, 0.5), (1, 3, None), (2, 5, 0.7)]


@pytest.mark.parametrize("parse", [markup.markdown_chunks, markup.latex_chunks])
def test_chunks_leave_python_in_bounded_parts(spark, monkeypatch, parse):
    """A batch of many texts is not held as a whole: what Python makes of it at once does not grow with it."""
    frames = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, schema: frames.append((run, schema)) or df)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    markup.chunked(docs, parse, "doc_id")
    texts = [None, "", *["some words here\n\nand there\n" * 2_000] * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(frames[0][0](iter([batch])))
    assert len(parts) > 4 and max(p.nbytes for p in parts) < 5 << 20
    got = [r for p in parts for r in p.to_pylist()]
    want = [(k, *chunk[:5]) for k, t in enumerate(texts) for chunk in parse(t or "")]
    assert [tuple(r[c] for c in ("doc_id", "pos", "kind", "start", "end", "text")) for r in got] == want
