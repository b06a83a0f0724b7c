"""The library's own operators on fixtures, and all queries against their SQL on the smallest tables."""

import itertools
import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import pairs, policy, scoring
from loomtext.functions import text as T
from loomtext.operators import cascade, chunks, markup, protect, slices
from loomtext.plans import catalogue, evaluation_queries
from loomtext.sources import files
from loomtext.streaming import scoring as stream

SF = "/root/testdata/sf0.001"
SLOW = {"explain_top3", "ensemble_missing_tier", "classify_counts", "stat_score", "metrics_long", "eval_cascade"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def normal(rows):
    show = lambda v: "null" if v is None or v != v else f"{float(v) + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}{'/*.parquet' if os.path.isdir(f'{SF}/{name}') else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = normal(df.select(*[f"`{n}`" for n in names]).collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    assert got == normal(rel.select(", ".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(("labels", "scores", "auroc", "ap"), [((0, 0, 1, 1), (0.1, 0.2, 0.8, 0.9), 1.0, 1.0), ((0, 1, 0, 1), (0.5,) * 4, 0.5, 0.5), ((1, 1), (0.1, 0.2), None, None)])
def test_ranking(spark, labels, scores, auroc, ap):
    rows = spark.createDataFrame(list(zip(labels, scores)), "y int, score double")
    r = slices.slice_metrics(rows, []).first()
    assert (r.auroc, r.auprc) == (auroc, ap) and r.n_samples == len(labels)


@pytest.mark.parametrize(("labels", "scores", "want"), [((0, 0, 1, 1), (0.0, 0.0, 1.0, 1.0), 0.0), ((0,) * 4, (0.9,) * 4, 0.9), ((1, 0), (0.3, 0.3), 0.2)])
def test_calibration_error(spark, labels, scores, want):
    rows = spark.createDataFrame(list(zip(labels, scores)), "y int, score double")
    assert math.isclose(slices.calibration_error(slices.sliced(rows, [])).first().calibration_error, want, abs_tol=1e-12)


def test_bins_and_buckets(spark):
    for x, want in ((0.3, 2), (0.30000000000000004, 3), (0.6, 5), (0.1, 1), (0.7, 6), (1.0, 9), (0.0, 0)):
        assert one(spark, slices.bin_of(F.lit(x))) == want, x
    assert one(spark, slices.intensity_bucket(F.lit(0.6))) == "0.40-0.60"
    assert one(spark, slices.intensity_bucket(F.lit(1.0))) == "0.80-1.00"


@pytest.mark.parametrize(("sizes", "want"), [([60], [[0]]), ([15, 15, 15], [[0, 1, 2]]), ([15, None, 15], [[0], [2]]), ([60, 15, 15], [[0], [1, 2]]), ([25, 25, 10], [[0, 1], [2]]), ([10], [[0]]), ([25, 25, 10, None, 60, 15], [[0, 1], [2], [4], [5]])])
def test_merge(spark, sizes, want):
    rows = [(i, "structural" if n is None else "prose", f"t{i}", n or 0) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(rows,)], "c array<struct<pos:int,kind:string,text:string,words:int>>")
    assert [list(g.members) for g in df.select(chunks.merge_short(F.col("c")).alias("g")).first().g] == want


def test_windows_and_splice(spark):
    assert one(spark, chunks.token_windows(F.lit(1000))) == [0, 256, 512]
    assert one(spark, chunks.token_windows(F.lit(510))) == [0]
    df = spark.createDataFrame([("a😀b\n\nccc\n\n \n\nd",)], "t string").withColumn("c", chunks.paragraphs(F.col("t")))
    rows = df.first()
    assert [(x.text, x.start, x.end) for x in rows.c] == [("a😀b", 0, 3), ("ccc", 5, 8), ("d", 13, 14)]
    new = df.select(chunks.splice(F.col("t"), F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("Z").alias("text")))).alias("x")).first().x
    assert new == "Z\n\nZ\n\n \n\nZ"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# h", "text", "", "- a", "  - b", "```", "$$", "> q", "    code", "| a | b |", "|---|---|", "---", "![x](y)", "<div>", "$x$ y"]), max_size=25))
def test_markdown_covers_all_lines(lines):
    text = "\n".join(lines)
    blocks = list(markup.markdown_chunks(text))
    at = 0
    for _, _, start, end, body, _ in blocks:
        assert start >= at and end > start and body == "\n".join(text.split("\n")[start:end])
        assert not any(x.strip() for x in text.split("\n")[at:start])
        at = end
    assert not any(x.strip() for x in text.split("\n")[at:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\begin{document}", "\\end{document}", "\\section{A b}", "word ", "\n\n", "$x$ ", "\\begin{equation}y\\end{equation}", "\\cite{k} ", "% note\n", "\\emph{in} ", "\\begin{itemize}", "\\end{itemize}", "\\item ", "{", "}", "\\"]), max_size=25))
def test_latex_offsets(parts):
    text = "".join(parts)
    for _, kind, start, end, body, math_ in markup.latex_chunks(text):
        for name, formula in math_.items():
            assert name in body
            body = body.replace(name, formula)
        assert 0 <= start < end <= len(text) and body == text[start:end] and kind in ("prose", "structural")


def test_latex_placeholders():
    text = "\\begin{document}\nFirst $a$ and \\(b\\).\n\nThen $c \\$ d$ at 5\\$.\n\\section{On $e$}\n\\begin{equation}$f$\\end{equation}\n\\end{document}"
    prose = [(body, math_) for _, kind, _, _, body, math_ in markup.latex_chunks(text) if kind == "prose"]
    assert prose == [
        ("First [MATH_001] and [MATH_002].", {"[MATH_001]": "$a$", "[MATH_002]": "\\(b\\)"}),
        ("Then [MATH_003] at 5\\$.", {"[MATH_003]": "$c \\$ d$"}),
        ("On [MATH_004]", {"[MATH_004]": "$e$"}),
    ]


def test_protection(spark):
    text, found = protect.protected("As (Miller, 2020) says, New York Times saw 42 of 7 Widgets.", ("widgets",), 10)
    assert set(found.values()) == {"(Miller, 2020)", "New York Times", "42", "7", "Widgets"}
    df = spark.createDataFrame([(text, found)], "t string, m map<string,string>")
    assert df.select(protect.restored(F.col("t"), F.col("m")).alias("x")).first().x == "As (Miller, 2020) says, New York Times saw 42 of 7 Widgets."
    assert df.select(protect.lost(F.col("m"), F.lit("only [TERM_001]")).alias("x")).first().x == sorted(set(found) - {"[TERM_001]"})
    with pytest.raises(Exception, match="placeholders remain"):
        df.select(protect.restored(F.lit("[TERM_099]"), F.col("m")).alias("x")).collect()


def test_protection_order():
    text, found = protect.protected("McDonald Corp of [MATH_003] met Big Tree 12 (Kim, 2001) and Red Fox.", ("big tree",), 4)
    assert text == "[TERM_006] of [MATH_003] met [TERM_005] 12 [TERM_004] and Red Fox." and list(found.values()) == ["(Kim, 2001)", "Big Tree", "McDonald Corp"]
    assert protect.protected("A B has Xy Zz and 7", (), 0) == ("A B has [TERM_001] and [TERM_000]", {"[TERM_000]": "7", "[TERM_001]": "Xy Zz"})


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("keeps [TERM_000] as is", {"[TERM_000]": "x"}, "keeps [TERM_000] as is"), ("the Red Fox and Red Fox", {"[TERM_000]": "Red Fox"}, "the [TERM_000] and Red Fox"),
        ("the RED fox ran", {"[TERM_000]": "Red Fox"}, "the [TERM_000] ran"), ("the red - fox ran", {"[TERM_000]": "Red Fox"}, "the [TERM_000] ran"), ("by S. Kim-Lee (2001)", {"[TERM_000]": "s. kim lee (2001)"}, "by [TERM_000]"),
        ("nothing here", {"[TERM_000]": "Red Fox"}, "nothing here"), ("a 7 b $x$", {"[TERM_000]": "7", "[MATH_001]": "$x$"}, "a [TERM_000] b [MATH_001]"),
    ],
)
def test_repair(spark, text, terms, want):
    df = spark.createDataFrame([(text, terms)], "t string, m map<string,string>")
    assert df.select(protect.repaired(F.col("t"), F.col("m")).alias("x")).first().x == want


@pytest.mark.parametrize(("a", "b", "want"), [("10% of 2.50", "10 % of 2.5", True), ("[MATH_001] 5", "5", False), ("02", "2", True), ("50%", "50", False), ("none", "", True)])
def test_verification(spark, a, b, want):
    assert one(spark, pairs.verification(F.lit(a), F.lit(b)))["passed"] is want


def test_similarity(spark):
    rows = [("the same text", "the same text"), ("", ""), ("a b", ""), ("Same Case Here", "same case here"), ("alpha beta gamma", "delta epsilon zeta")]
    df = pairs.quick_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    got = [r.quick_similarity for r in df.select("quick_similarity").collect()]
    assert got[0] == pytest.approx(1) and got[1] == 1 and got[2] == 0 and got[3] == pytest.approx(1) and got[4] < 0.5


@pytest.mark.parametrize(
    ("text", "want"),
    [("short", "too_short"), ("# A heading that is long enough to pass the shortest length", "title_like"), ("where [MATH_001]s denote the thing that we look at all day", "math_heavy"), ("where [MATH_001] denotes the thing that we look at all day", None),
     ("f(x) = a_b * c_d + e_f - g_h and so on for a while longer here", "equation_like"), ("An ordinary sentence that is long enough to be rewritten by anyone.", None)],
)
def test_policy(spark, text, want):
    assert one(spark, policy.skip_reason(F.lit(text))) == want


def test_scoring(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scoring.ensemble([F.lit(0.5), none, F.lit(0.9)], (0.4, 0.15, 0.45))) == pytest.approx((0.4 * 0.5 + 0.45 * 0.9) / 0.85)
    assert one(spark, scoring.interpolated(F.lit(0.5), [(0.0, 0.0), (1.0, 0.5)])) == 0.25
    assert one(spark, scoring.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]
    assert one(spark, T.variance(F.array(F.lit(1.0), F.lit(3.0)))) == 1.0
    assert [one(spark, cascade.operator_for(F.lit(i), F.lit(4), F.lit(0), F.lit(0))) for i in range(5)] == ["STANDARD", "RESTRUCTURE", "VOICE_SHIFT", "VOCABULARY", "STANDARD"]
    assert one(spark, cascade.echoes(F.lit("Well,\n CRITICAL   rules apply")))


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "web" / "human").mkdir(parents=True)
    (tmp_path / "in" / "web" / "human" / "a.txt").write_text("One text.")
    (tmp_path / "in" / "b.MD").write_text("# Head")
    docs = {r.format: r.text for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert docs == {"plaintext": "One text.", "markdown": "# Head"}
    r = files.read_corpus(spark, str(tmp_path / "in")).first()
    assert (r.domain, r.source_class) == ("web", "human")
    files.write_jsonl(files.read_corpus(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 1
    spark.createDataFrame([(1, "word " * 60), (2, "few")], "doc_id long, text string").write.parquet(str(tmp_path / "s"))
    stream.score_stream(spark, str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {x.doc_id: x.classification for x in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got[2] is None and got[1] in ("human", "ambiguous", "ai_generated")


def test_reports(spark):
    rows = spark.createDataFrame([(1, 0, "abcdefghij", 0.5, "ambiguous", "text"), (1, 1, "klmnopqrst", 0.9, "ai_generated", "more")], "doc_id long, pos int, chunk_id string, score double, label string, text string")
    assert files.text_report(rows).first().report.split("\n")[1] == "  [abcdefgh] ambiguous score=0.500 text"
    assert '"n_chunks":2' in files.json_report(rows).first().report
    m = slices.slice_metrics(spark.createDataFrame([(0, 0.2, "x"), (1, 0.8, "y")], "y int, score double, d string"), ["d"])
    assert files.summary_markdown(m).startswith("## overall")


def test_metrics_have_the_digits_of_the_double(spark, duck):
    values = [0.12345, 0.00005, 0.00015, 0.03125, 0.09375, 0.2, 1.0, 0.0, -0.12345, 12.34565, 1 / 3, None]
    got = [r.x for r in files.metrics_rows(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)).collect()]
    assert got == [None if v is None else f"{v:.4f}" for v in values] == [duck.execute("select printf('%.4f', ?::double)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize(("value", "digits"), [(0.575, 2), (0.46499999999999997, 2), (math.nextafter(0.1234565, 0), 6), (math.nextafter(0.2345675, 0), 6), (0.0078125, 6), (-0.575, 2), (None, 6)])
def test_rounding_is_that_of_the_sql(spark, duck, value, digits):
    assert one(spark, evaluation_queries.rounded(F.lit(value).cast("double"), digits)) == duck.execute(f"select round(?::double, {digits})", [value]).fetchone()[0]


def test_metrics_report_at_ties(spark, tmp_path):
    import duckdb

    words = ["".join(p) for p in itertools.product("abcdefgh", repeat=3)]
    docs = [(i, "en", "s", " ".join(words[:60]) if i else "word " * 60) for i in range(32)]  # one of 32 is flagged: 0.03125
    docs += [(32, "de", "s", " ".join(words[:199] + words[:1] * 201))]  # its score is 0.575, whose double lies just below
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, d[0] % 2) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = normal(catalogue.queries()["metrics_report"](spark, str(tmp_path)).collect())
    assert got == normal(c.sql(catalogue.oracle_sql()["metrics_report"]).fetchall())
    assert ("lang", "en", "32", "0.0312", "0.0312") in got and ("lang", "de", "1", "1.0000", "0.5700") in got
