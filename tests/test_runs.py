"""Settings, documents of several formats, reports and a model's numbers, on fixtures."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import signals
from loomtext.operators import documents, reports, slices
from loomtext.sources import files, settings

TEX = "\\documentclass{article}\n\\begin{document}\n\\section{Start here}\nFirst words with $x+1$.\n\nSecond \\emph{part}.\n\\begin{equation}y\\end{equation}\n\\end{document}\n"
MD = "---\nkey: 1\n---\n\n# Title\n\nOne line\nand more.\n\n```\ncode\n```\n\n- a\n- b\n"
TXT = "First paragraph.\n\nSecond one\nof two lines.\n\n\n   \n\nLast.\n"


def test_manifest(tmp_path):
    m = settings.Manifest("n", "d.jsonl", ("a", "b"), ("auroc",), ("domain",), ({"operator": "STANDARD", "intensities": [0.5, 1.0]},), 7)
    settings.write_manifest(m, f"{tmp_path}/x/m.yaml")
    assert settings.read_manifest(f"{tmp_path}/x/m.yaml") == m
    Path(f"{tmp_path}/few.yaml").write_text("name: n\ndataset: d\ndetectors: [a]\nmetrics: [m]\nslices: []\n")
    assert settings.read_manifest(f"{tmp_path}/few.yaml").seed == 42
    for text, say in (("name: n\n", "lacks dataset, detectors"), ("- 1\n", "no mapping"), ("a: [", "no YAML"), ("name: n\ndataset: d\ndetectors: []\nmetrics: []\nslices: []\ntransforms: [{operator: X}]\n", "needs operator")):
        Path(f"{tmp_path}/bad.yaml").write_text(text)
        with pytest.raises(ValueError, match=say):
            settings.read_manifest(f"{tmp_path}/bad.yaml")


def test_layers(tmp_path):
    Path(f"{tmp_path}/user.toml").write_text("[a]\nx = 2\nlist = [3]\n[b]\nz = 'w'\n")
    got = settings.layered({"a": {"x": 1, "y": 1, "list": [1, 2]}}, f"{tmp_path}/none.toml", f"{tmp_path}/user.toml", overrides={"a.y": "0.5", "c.d.e": "TRUE", "a.x": "7", "b.z": "text"})
    assert got == {"a": {"x": 7, "y": 0.5, "list": [3]}, "b": {"z": "text"}, "c": {"d": {"e": True}}}


def test_examples(tmp_path):
    Path(f"{tmp_path}/law.toml").write_text("[[pairs]]\ninput = 'a'\noutput = 'b'\n")
    Path(f"{tmp_path}/bad.toml").write_text("[[pairs]]\ninput = 'a'\n")
    with pytest.warns(UserWarning, match="bad.toml"):
        assert settings.read_examples(str(tmp_path)) == {"law": [("a", "b")]}


def test_calibration(spark, tmp_path):
    for method, parameters, want in (("temperature_scaling", {"temperature": 2.0}, 1 / (1 + np.exp(-np.log(0.8 / 0.2) / 2))), ("isotonic", {"breakpoints": [[0.0, 0.1], [1.0, 0.6]]}, 0.5), ("slice_thresholds", {}, 0.8)):
        settings.write_calibration(settings.Calibration(method, "v1", parameters), f"{tmp_path}/c/{method}.json")
        c = settings.read_calibration(f"{tmp_path}/c/{method}.json")
        got = spark.range(1).select(signals.calibrated(F.lit(0.8), c.method, c.parameters).alias("x")).first().x
        assert c.version == "v1" and abs(got - want) < 1e-12
    with pytest.raises(ValueError, match="unknown"):
        signals.calibrated(F.lit(0.5), "other", {})


def test_progress(spark, tmp_path):
    docs = spark.createDataFrame([("a", "c1"), ("b", "c2")], "digest string, chunk_id string")
    path = f"file://{tmp_path}/progress"
    assert settings.load_progress(spark, path, docs, "detecting").count() == 0
    settings.save_progress(docs.withColumn("score", F.lit(0.5)), path, "detecting")
    settings.save_progress(docs.filter("chunk_id = 'c1'").withColumn("score", F.lit(0.75)), path, "detecting")
    changed = spark.createDataFrame([("a",), ("new",)], "digest string")
    rows = settings.load_progress(spark, path, changed, "detecting").collect()
    assert [(r.chunk_id, json.loads(r.result)["score"]) for r in rows] == [("c1", 0.75)]
    assert settings.load_progress(spark, path, changed, "evaluating").count() == 0


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "latex", TEX), (2, "markdown", MD), (3, "plaintext", TXT), (4, "plaintext", ""), (5, "latex", None)], "doc_id long, format string, text string")
    rows = documents.parsed(docs, "doc_id").collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert [r.text for r in rows if r.doc_id == 3] == ["First paragraph.", "Second one\nof two lines.", "Last.\n"] and [r.kind for r in rows if r.doc_id == 2] == ["structural", "prose", "prose", "structural", "prose"]
    with_math = {r.doc_id: r for r in rows if r.math}
    assert with_math[1].text == "First words with [MATH_001]." and with_math[1].math == {"[MATH_001]": "$x+1$"}
    # Putting each prose chunk back as it was changes nothing; putting other words there changes only those.
    prose = [r for r in rows if r.kind == "prose"]
    raw = {1: TEX, 2: MD, 3: TXT}
    same = [(r.doc_id, r.start, r.end, "\n".join(MD.split("\n")[r.start : r.end]) if r.doc_id == 2 else raw[r.doc_id][r.start : r.end]) for r in prose]
    kind = "doc_id long, start int, end int, text string"
    back = documents.rebuilt(docs, spark.createDataFrame(same, kind)).collect()
    assert {r.doc_id: r.text for r in back} == {**raw, 4: "", 5: None}
    new = documents.rebuilt(docs, spark.createDataFrame([(r.doc_id, r.start, r.end, "NEW") for r in prose], kind))
    text = {r.doc_id: r.text for r in new.collect()}
    assert text[3] == "NEW\n\nNEW\n\n\n   \n\nNEW" and text[2] == "---\nkey: 1\n---\n\nNEW\n\nNEW\n\n```\ncode\n```\n\nNEW\n" and "\\begin{equation}y" in text[1] and "First" not in text[1]
    named = new.filter("doc_id < 4").withColumn("path", documents.output_path(F.concat(F.lit(f"file://{tmp_path}/a.b/d"), F.col("doc_id").cast("string"), F.lit(".md"))))
    assert sum(r["size"] for r in documents.write_documents(named).collect()) == sum(len(t.encode()) for i, t in text.items() if i < 4)
    assert {p.name: p.read_text() for p in Path(f"{tmp_path}/a.b").iterdir()} == {f"d{i}_transformed.md": text[i] for i in (1, 2, 3)}
    with pytest.raises(Exception, match="no parser for format pdf"):
        documents.parsed(docs.withColumn("format", F.lit("pdf")), "doc_id").collect()


@pytest.mark.parametrize(("path", "want"), [("/x/a.tex", "/x/a_transformed.tex"), ("/x.y/a", "/x.y/a_transformed"), ("/x/a.b.md", "/x/a.b_transformed.md")])
def test_output_path(spark, path, want):
    assert spark.range(1).select(documents.output_path(F.lit(path)).alias("x")).first().x == want


@pytest.mark.parametrize(("text", "bad"), [("", False), ("$x$", False), ("a $ b", True), ("a \\$ b", False), ("`$` and ```\n$\n``` $", True), ("$$x$$ and $", True)])
def test_markdown_errors(spark, text, bad):
    assert (spark.range(1).select(documents.markdown_error(F.lit(text)).alias("x")).first().x is not None) == bad


def test_numbers_against_numpy(spark):
    rng = random.Random(3)
    rows = [[rng.gauss(-3, 2) for _ in range(n)] for n in (0, 1, 2, 3, 20, 101)] + [[-1.5] * 4]
    df = spark.createDataFrame([(i, r, [rng.choice((5, 10, 12)) for _ in r]) for i, r in enumerate(rows)], "i int, v array<double>, n array<int>")
    for r in df.select("*", signals.token_distribution(F.col("v")).alias("d"), signals.sentence_losses(F.col("v"), F.col("n")).alias("s"), signals.window_score(F.col("v")).alias("w")).collect():
        a = np.array(r.v)
        assert r.w is None if not len(a) else abs(r.w - a.mean()) < 1e-9
        if len(a) < 2:
            assert r.d is None
        else:
            s = a.std()
            want = (a.mean(), s, ((a - a.mean()) ** 3).mean() / s**3 if s else 0.0, ((a - a.mean()) ** 4).mean() / s**4 - 3 if s else 0.0, (a < np.percentile(a, 10)).mean())
            assert np.allclose(tuple(r.d), want, atol=1e-9)
        kept = np.array([x for x, n in zip(r.v, r.n) if n >= 10])
        assert r.s is None if len(kept) < 3 else np.allclose(tuple(r.s), (kept.mean(), kept.std(), kept.min(), kept.max()))


def test_small_columns(spark):
    scores = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(s).alias("score")) for k, s in (("a", 0.2), ("b", 0.4), ("c", 0.4))])
    row = spark.range(1).select(signals.top_label(scores).alias("top"), *[signals.generation_size(F.lit(n)).alias(f"g{n}") for n in (10, 300, 5000)], *[signals.duration_text(F.lit(float(s))).alias(f"d{s}") for s in (3, 245, 3723)]).first()
    assert tuple(row) == ("b", 512, 780, 2048, "3.0s", "4m 5.0s", "1h 2m 3.0s")


def run_tables(spark):
    chunks = spark.createDataFrame([(1, "c1aaaaaaaa", 0, "prose", 0, 5, "First"), (1, "c2aaaaaaaa", 1, "structural", 7, 10, "$x$"), (1, "c3aaaaaaaa", 2, "prose", 12, 16, "Last"), (2, "d1", 0, "prose", 0, 4, "Solo")], "doc_id long, chunk_id string, pos int, kind string, start int, end int, text string")
    detections = spark.createDataFrame([(1, "c1aaaaaaaa", 0, 0.2, "human"), (1, "c1aaaaaaaa", 1, 0.9, "ai_generated"), (1, "c3aaaaaaaa", 0, 0.5, "ambiguous")], "doc_id long, chunk_id string, seq int, score double, label string")
    rewrites = spark.createDataFrame([(1, "c1aaaaaaaa", 0, "First", "Changed", "STANDARD", None, {"retries_used": 2}), (1, "c1aaaaaaaa", 1, "First", "First", "REORDER", "keep", {"placeholder_failures": 3})], "doc_id long, chunk_id string, seq int, original string, rewritten string, operator string, fallback string, diagnostics map<string,int>")
    evaluations = spark.createDataFrame([(1, "c1aaaaaaaa", 0, False, "nli", "no entailment")], "doc_id long, chunk_id string, seq int, passed boolean, stage string, reason string")
    docs = spark.createDataFrame([(1, "/x/a.md", "markdown", "First\n\n$x$\n\nLast"), (2, "/x/b.tex", "latex", "Solo")], "doc_id long, path string, format string, text string")
    return docs, chunks, detections, rewrites, evaluations


def test_run_reports(spark):
    docs, chunks, detections, rewrites, evaluations = run_tables(spark)
    rows = {r.chunk_id: r for r in reports.joined(chunks, detections, rewrites, evaluations).collect()}
    assert rows["c1aaaaaaaa"].detection.label == "ai_generated" and rows["c1aaaaaaaa"].rewrite.operator == "REORDER" and rows["d1"].detection is None
    assert [r.chunk_id for r in reports.targets(chunks, detections).collect()] == ["c1aaaaaaaa"]
    assert {r.chunk_id for r in reports.targets(chunks, detections, ambiguous=True).collect()} == {"c1aaaaaaaa", "c3aaaaaaaa"}
    assert [(r.operator, r.fallback) for r in reports.rejected(evaluations, rewrites).collect()] == [("STANDARD", None)]
    failures = spark.createDataFrame([(1, "c3aaaaaaaa", "Request timeout"), (2, "d1", "x" * 99)], "doc_id long, chunk_id string, reason string")
    s = {r.doc_id: r for r in reports.run_summary(chunks, detections, rewrites, evaluations, failures).collect()}
    assert (s[1].total_chunks, s[1].prose_chunks, s[1].ai_detected, s[1].transformed, s[1].unchanged, s[1].eval_failed, s[1].retries_used, s[1].placeholder_failures, s[1].failed) == (3, 2, 2, 1, 1, 1, 2, 3, 1)
    assert s[1].operator_usage == {"STANDARD": 1, "REORDER": 1} and s[1].fallback_modes == {"keep": 1} and s[1].failure_reasons == {"LLM timeout": 1} and s[2].failure_reasons == {"x" * 80: 1} and s[2].ai_detected == 0
    found = {r.doc_id: json.loads(r.report) for r in reports.report("json", docs, chunks, detections, rewrites, evaluations, at="2001-01-01").collect()}
    assert found[1]["input_path"] == "/x/a.md" and found[1]["timestamp"] == "2001-01-01" and found[1]["summary"]["ai_detected"] == 2
    assert [c["id"] for c in found[1]["chunks"]] == ["c1aaaaaaaa", "c2aaaaaaaa", "c3aaaaaaaa"] and found[1]["chunks"][0]["evaluation"]["stage"] == "nli" and "detection" not in found[2]["chunks"][0]
    text = {r.doc_id: r.report for r in reports.report("text", docs, chunks, detections, rewrites, evaluations).collect()}
    assert "  Total chunks:     3\n" in text[1] and "  [c1aaaaaa] FAIL stage=nli (no entailment)" in text[1] and "op=REORDER retries=0 placeholder_failures=3" in text[1] and "Detection" not in text[2]
    marked = {r.doc_id: r.report for r in reports.report("annotated", docs, chunks, detections).collect()}
    assert marked == {1: "<!-- chunk=c1aaaaaa score=0.900 class=ai_generated -->\nFirst\n\n$x$\n\n<!-- chunk=c3aaaaaa score=0.500 class=ambiguous -->\nLast", 2: "Solo"}
    for kind, say in (("pdf", "unknown"), ("json", "need rewrites")):
        with pytest.raises(ValueError, match=say):
            reports.report(kind, docs, chunks, detections)


def test_results_of_an_experiment(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.9, "law"), (0, 0.2, "law"), (1, 0.7, "web"), (0, 0.8, None)], "y int, score double, domain string")
    metrics = slices.slice_metrics(rows, slices.legal(["domain"]))
    detections = spark.createDataFrame([("r1", "s1", "d", 0.5, "ambiguous")], "record_id string, sample_id string, detector_name string, score double, predicted_label string")
    files.write_results(detections, metrics, f"file://{tmp_path}/out")
    (part,) = Path(f"{tmp_path}/out/metrics.csv").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "dimension,value,n_samples,auroc,auprc,tpr_at_fpr5,human_fpr,mean_score_human,mean_score_ai,calibration_error"
    assert [x.split(",")[:4] for x in lines[1:]] == [["overall", "all", "4", "0.7500"], ["domain", "law", "2", "1.0000"], ["domain", "web", "1", ""]]
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/summary.md").collect()][0] == "## overall"
    back = files.read_jsonl(spark, f"{tmp_path}/out/detections.jsonl", files.DETECTION).first()
    assert (back.record_id, back.score, back.predicted_label) == ("r1", 0.5, "ambiguous")
    with pytest.raises(ValueError, match="invalid dimension 'lang'"):
        slices.legal(["domain", "lang"])


def test_bad_inputs(spark, tmp_path):
    Path(f"{tmp_path}/empty").mkdir()
    Path(f"{tmp_path}/empty/x.pdf").write_text("no document")
    for read in (files.read_documents, files.read_corpus):
        with pytest.raises(ValueError, match="below"):
            read(spark, f"{tmp_path}/empty")
    with pytest.raises(Exception, match="no format for /x/a.mkd"):
        spark.range(1).select(files.required_format(F.lit("/x/a.mkd"))).collect()
    Path(f"{tmp_path}/bad.jsonl").write_text('\n{"record_id": "r", "score": 0.5, "predicted_label": "human"}\n{"record_id": "q", "score": 1.5, "predicted_label": "human"}\n')
    with pytest.raises(Exception, match="bad score: 1.5"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", files.DETECTION).collect()
    Path(f"{tmp_path}/worse.jsonl").write_text('{"record_id": \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        files.read_jsonl(spark, f"{tmp_path}/worse.jsonl", files.DETECTION).collect()
