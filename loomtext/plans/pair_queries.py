"""Queries over pairs of texts, chunks and rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions import pairs as P
from loomtext.functions import policy
from loomtext.functions import text as T
from loomtext.operators import cascade as K
from loomtext.operators import chunks as O
from loomtext.plans import sql as Q


def pairs(spark, sf_dir) -> DataFrame:
    """Each document as the original of the next one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(n, "doc_id")


def drift_metrics(spark, sf_dir):
    names = ["numeric_drift", "citation_drift", "entity_drift", "heading_preservation", "sentence_length_variance", "lexical_diversity", "term_preservation"]
    return P.measured(pairs(spark, sf_dir), names, "a", "b").select("doc_id", *[F.round(n, 6).alias(n) for n in names])


def metrics_long(spark, sf_dir):
    """The same in long form: one row per pair and metric, then averaged."""
    names = sorted(P.METRICS)
    wide = P.measured(pairs(spark, sf_dir), names, "a", "b").select("doc_id", *names)
    long = wide.unpivot("doc_id", names, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def term_verify(spark, sf_dir):
    v = pairs(spark, sf_dir).select("doc_id", P.verification(F.col("a"), F.col("b")).alias("v"))
    return v.select("doc_id", "v.passed", F.coalesce("v.reason", F.lit("")).alias("reason"))


def token_overlap(spark, sf_dir):
    df = P.overlaps(pairs(spark, sf_dir), "a", "b")
    return df.select("doc_id", F.round("unigram_overlap", 6).alias("unigram_overlap"), F.round("bigram_overlap", 6).alias("bigram_overlap"))


def turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations with the one before: short pairs."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("b"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("a"))
    return c.join(before, ["conv_id", "turn"])


def quick_similarity(spark, sf_dir):
    df = P.quick_similarity(turns(spark, sf_dir), "a", "b")
    return df.select("conv_id", "turn", F.round("quick_similarity", 6).alias("quick_similarity"))


def quick_similarity_documents(spark, sf_dir):
    """The same over whole documents, as the other pair queries."""
    df = P.quick_similarity(pairs(spark, sf_dir), "a", "b")
    return df.select("doc_id", F.round("quick_similarity", 6).alias("quick_similarity"))


def embedding_cosine(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(P.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


def paragraphs_with_offsets(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    d = d.withColumn("c", O.paragraphs(F.col("t"), "\n+"))
    return O.exploded(d, "c", "doc_id").select("doc_id", "pos", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def roundtrip(spark, sf_dir):
    """Every second paragraph in capitals, put back by offsets, and the original put back into that: nothing else may change."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("c", O.paragraphs(F.col("t"), "\n+"))
    odd = F.filter("c", lambda x: x["pos"] % 2 == 1)
    d = d.withColumn("marks", F.transform(odd, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("<p>").alias("text"))))
    d = d.withColumn("same", F.transform(odd, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))
    return d.select("doc_id", F.md5(O.splice(F.col("t"), F.col("marks")).cast("binary")).alias("changed"), (O.splice(F.col("t"), F.col("same")) == F.col("t")).alias("identical"))


def merge_short_turns(spark, sf_dir):
    """Turns of a conversation as chunks: system turns are structural, the others prose."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    row = F.struct(F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "system", "structural").otherwise("prose").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.size(T.spaced(F.coalesce("text", F.lit("")))).alias("words"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("chunks"))  # a conversation is one document
    g = g.select("conv_id", F.posexplode(O.merge_short(F.col("chunks"))).alias("pos", "m"))
    return g.select("conv_id", (F.col("pos") + 1).cast("long").alias("group_no"), F.col("m.words").cast("long").alias("words"), F.array_join(F.col("m.members").cast("array<string>"), ",").alias("members"))


def lines(spark, sf_dir) -> DataFrame:
    """Whole lines of documents, some with markup that the policy looks for, or only their letters as a citation's key."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    k = (F.col("doc_id") + F.col("line")) % 9
    with_mark = lambda mark, rest: F.concat(F.lit(mark), rest)
    marked = (
        F.when(k == 1, with_mark("## ", F.col("text"))).when(k == 2, F.concat(F.lit("Note: "), F.regexp_replace("text", "[.!?]", ""), F.lit(" and so")))
        .when(k == 3, with_mark("x = a_b + c_d * f(x) ", F.col("text"))).when(k == 4, with_mark("where [MATH_001] is ", F.col("text"))).when(k == 5, F.concat(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit("2020"))).otherwise(F.col("text"))
    )
    return d.select("doc_id", "line", marked.alias("text"))


def skip_reason(spark, sf_dir):
    rows = lines(spark, sf_dir).select(policy.skip_reason(F.col("text")).alias("reason"))
    return rows.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def token_windows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n", F.size(T.spaced(F.coalesce("text", F.lit("")))))
    w = d.select("doc_id", "n", F.explode(O.token_windows(F.col("n"))).alias("start"))
    return w.groupBy("doc_id").agg(F.count("*").alias("windows"), F.max("start").alias("last_start"), F.round(F.avg(F.least(F.lit(C.WINDOW), F.col("n") - F.col("start"))), 6).alias("mean_size"))


def rewrites(spark, sf_dir) -> DataFrame:
    """Pairs with stand-ins for a model's labels, from their ids."""
    df = P.overlaps(pairs(spark, sf_dir), "a", "b").withColumn("v", P.verification(F.col("a"), F.col("b")))
    kinds = F.array(*[F.lit(x) for x in ("entailment", "neutral", "contradiction", "entailment")])
    return df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("v.reason")).alias("term_reason"), F.round(F.col("unigram_overlap"), 3).alias("similarity"), F.get(kinds, F.pmod("doc_id", F.lit(4)).cast("int")).alias("nli_forward"), F.get(kinds, F.pmod(F.col("doc_id") + 1, F.lit(3)).cast("int")).alias("nli_backward"))


def eval_cascade(spark, sf_dir):
    out = K.evaluated(rewrites(spark, sf_dir), similarity=0.1)
    return out.select("doc_id", "passed", "stage", "rejection_reason", "similarity", "nli_forward", "nli_backward")


def rejection_summary(spark, sf_dir):
    out = K.evaluated(rewrites(spark, sf_dir), similarity=0.1)
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def candidate_best(spark, sf_dir):
    """Five candidates per document with scores and similarities from hashes; the search's choice."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    part = lambda i, k: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string"), F.lit(k)).cast("binary")), 1, 4), 16, 10).cast("long") / 65535.0
    made = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.alias("iteration"), (0.3 + 0.7 * part(i, "s")).alias("score"), (0.5 + 0.1 * part(i, "t")).alias("sim")))
    return d.withColumn("w", K.chosen(made)).select("doc_id", F.col("w.iteration").cast("long").alias("iteration"), F.round("w.score", 6).alias("score"), F.round("w.sim", 6).alias("sim"))


def operator_choice(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("i"))
    op = K.operator_for(F.col("i"), F.col("i") % 8, F.floor(F.col("i") / 8) % 3, F.floor(F.col("i") / 24) % 6)
    return d.select(op.alias("operator")).groupBy("operator").agg(F.count("*").alias("n"))


def resume_pending(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return K.pending(d, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


PAIRS = "with p as (select d.doc_id, coalesce(d.text, '') a, coalesce(n.text, '') b from documents d join documents n on n.doc_id = d.doc_id + 1)"


def entities_sql(w: str) -> str:
    """Of a column of words."""
    edge = r"""^[.,;:!?"''()\[\]]+|[.,;:!?"''()\[\]]+$"""
    rows = f"list_transform(range(2, len({w}) + 1), lambda i: case when not regexp_matches({w}[i - 1], '[.!?]$') then regexp_replace({w}[i], '{edge}', '', 'g') end)"
    return rf"list_filter({rows}, lambda w: w is not null and regexp_full_match(w, '\p{{Lu}}\p{{L}}*'))"


def kept_sql(before: str, after: str, none: str) -> str:
    return f"case when len(list_distinct({before})) = 0 then {none} else len(list_intersect(list_distinct({before}), list_distinct({after})))::double / len(list_distinct({before})) end"


def metrics_sql() -> str:
    ex = lambda t, p: f"regexp_extract_all({t}, '{p}')"
    others = ex(r"regexp_replace(b, '(\d)\s+%', '\1%', 'g')", P.NUMBER)
    same = "((ends_with(x, '%') = ends_with(y, '%')) and coalesce(try_cast(replace(x, '%', '') as decimal(38,18)) = try_cast(replace(y, '%', '') as decimal(38,18)), x = y))"
    return PAIRS + rf""",
s as (select *, {Q.spaced('a')} sa, {Q.spaced('b')} sb, {others} others from p),
e as (select *, {entities_sql('sa')} ea, {entities_sql('sb')} eb, {Q.spaced('lower(b)')} wb,
  list_transform({Q.sentences('b')}, lambda s: len({Q.spaced('s')})::double) lens,
  list_sort(list_filter(list_distinct({ex('a', P.PLACEHOLDER)}), lambda x: not list_contains({ex('b', P.PLACEHOLDER)}, x))) marks,
  list_sort(list_distinct(list_filter({ex('a', P.NUMBER)}, lambda x: len(list_filter(others, lambda y: {same})) = 0))) nums from s),
v as (select *, concat_ws('; ', case when len(marks) > 0 then 'missing placeholders: ' || array_to_string(marks, ', ') end, case when len(nums) > 0 then 'missing numbers: ' || array_to_string(nums, ', ') end) reason from e),
m as (
  select doc_id, {kept_sql(ex('a', P.DRIFT_NUMBER), ex('b', P.DRIFT_NUMBER), '0')} numeric_drift, {kept_sql(ex('a', P.CITATION), ex('b', P.CITATION), '1')} citation_drift,
    {kept_sql('ea', 'eb', '1')} entity_drift,
    case when len({ex('a', P.HEADINGS)}) = 0 then 1 else len(list_filter({ex('a', P.HEADINGS)}, lambda h: list_contains({ex('b', P.HEADINGS)}, h)))::double / len({ex('a', P.HEADINGS)}) end heading_preservation,
    coalesce(list_var_pop(lens), 0) sentence_length_variance, case when len(wb) = 0 then 0 else len(list_distinct(wb))::double / len(wb) end lexical_diversity,
    (reason = '')::int::double term_preservation, reason
  from v)"""


def overlap_sql() -> str:
    tok = lambda t: f"regexp_extract_all(lower({t}), '{P.TOKEN}')"
    two = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    jac = lambda x, y: f"case when len({x}) = 0 and len({y}) = 0 then 1 else len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))) end"
    return PAIRS + f""",
k as (select *, {tok('a')} ta, {tok('b')} tb from p), l as (select *, list_distinct(ta) ua, list_distinct(tb) ub, list_distinct({two('ta')}) ba, list_distinct({two('tb')}) bb from k),
o as (select doc_id, a, b, {jac('ua', 'ub')} unigram_overlap, {jac('ba', 'bb')} bigram_overlap from l)"""


def cascade_sql() -> str:
    no = "(f = 'contradiction' or b = 'contradiction')"
    return overlap_sql() + ", " + metrics_sql().removeprefix(PAIRS + ",").strip() + f""",
r as (
  select o.doc_id, case when o.doc_id % 3 = 0 and reason <> '' then reason end term_reason, round(unigram_overlap, 3) s,
    ['entailment', 'neutral', 'contradiction', 'entailment'][(o.doc_id % 4 + 1)::int] f, ['entailment', 'neutral', 'contradiction'][((o.doc_id + 1) % 3 + 1)::int] b
  from o join m using (doc_id)),
g as (select *, term_reason is null t, term_reason is null and s >= 0.1 c, term_reason is null and s >= 0.1 and not {no} and (f = 'entailment' or b = 'entailment') n from r),
x as (
  select doc_id, n passed, case when not t then 'terms' when not c then 'similarity' when not n then 'nli' else 'passed' end stage,
    case when not t then term_reason when not c then printf('embedding similarity %.3f below threshold %.2f', s, 0.1::double)
      when not n then case when {no} then 'NLI detected contradiction (forward=' || f || ', backward=' || b || ')'
        else 'NLI relaxed mode requires entailment in at least one direction but got forward=' || f || ', backward=' || b end end rejection_reason,
    case when t then s end similarity, case when c then f end nli_forward, case when c then b end nli_backward
  from g)"""


def policy_sql() -> str:
    fix = lambda p: p.replace("'", "''")
    n = lambda p: f"len(regexp_extract_all(t, '{fix(p)}'))"
    m = lambda p: f"regexp_matches(t, '{fix(p)}')"
    one = r"contains(t, chr(10))"
    return rf"""
with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) line from documents),
k as (select *, (doc_id + line) % 9 k from d),
l as (select regexp_replace(case when k = 1 then '## ' || text when k = 2 then 'Note: ' || regexp_replace(text, '[.!?]', '', 'g') || ' and so'
  when k = 3 then 'x = a_b + c_d * f(x) ' || text when k = 4 then 'where [MATH_001] is ' || text when k = 5 then regexp_replace(text, '[^A-Za-z]', '', 'g') || '2020' else text end, '^\s+|\s+$', '', 'g') t from k),
f as (select t, t = '' or length(t) < {C.MIN_PROSE} short, {m(policy.LINE_BREAK)} or {m(policy.CITATION_KEY)} or (not contains(t, ' ') and length(t) < {policy.SHORT_WORD}) frag,
  not {one} and ({m(policy.HEADING)} or {m(policy.BOLD)} or ({m(policy.NUMBERED)} and length(t) <= 120) or ({n(policy.TITLE_WORD)} between 1 and 12 and not {m('[.!?]$')} and contains(t, ':') and length(t) <= 120)) title,
  {n(policy.MATH)} > 0 and ({m(policy.PURE_MATH)} or (length(t) <= 120 and {m(policy.MATH_NOTE)}) or ({n(policy.MATH)} * 10.0 / length(t) > 0.4)) math,
  length(t) <= 220 and ((contains(t, '=') and {n(policy.SYMBOL)} >= 4) or ({n(policy.FORMULA)} >= 2 and {n(policy.SYMBOL)} >= 3) or (not {one} and contains(t, '=') and {n(policy.FORMULA)} >= 1)) eq from l)
select case when short then 'too_short' when frag then 'latex_fragment' when title then 'title_like' when math then 'math_heavy' when eq then 'equation_like' else 'none' end reason, count(*) n from f group by 1"""


def oracle_sql() -> dict[str, str]:
    names = ["numeric_drift", "citation_drift", "entity_drift", "heading_preservation", "sentence_length_variance", "lexical_diversity", "term_preservation"]
    rows = " union all ".join(f"select '{n}' metric, {n}::double x from m" for n in sorted(P.METRICS))
    h = lambda k: f"(('0x' || substr(md5(doc_id || '-' || i || '-{k}'), 1, 4))::bigint / 65535.0::double)"
    better = f"""case when c.sim > w.sim + {C.PRIORITY_MARGIN} then true when w.sim > c.sim + {C.PRIORITY_MARGIN} then false
      when (c.score >= {C.SCORE_FLOOR}) = (w.score >= {C.SCORE_FLOOR}) then case when c.score <> w.score then c.score < w.score else c.sim > w.sim end else c.score >= {C.SCORE_FLOOR} end"""
    parts = """
with d as (select doc_id, coalesce(text, '') t from documents),
s as (select doc_id, t, unnest(regexp_split_to_array(t, '\\n+')) part, unnest(range(0, len(regexp_split_to_array(t, '\\n+')))) k from d),
c as (select doc_id, t, part, k, sum(length(part)) over (partition by doc_id order by k) - length(part) chars from s),
g as (select doc_id, unnest(regexp_extract_all(t, '\\n+')) gap, unnest(range(1, len(regexp_extract_all(t, '\\n+')) + 1)) k from d),
h as (select doc_id, k, sum(length(gap)) over (partition by doc_id order by k) gaps from g),
p as (select c.doc_id, c.t, part, c.k, chars + coalesce(gaps, 0) start from c left join h on h.doc_id = c.doc_id and h.k = c.k where regexp_matches(part, '\\S')),
q as (select doc_id, t, part, start, row_number() over (partition by doc_id order by k) - 1 pos, start + length(part) stop from p)"""
    return {
        "drift_metrics": metrics_sql() + " select doc_id, " + ", ".join(f"round({n}, 6)::double {n}" for n in names) + " from m",
        "metrics_long": metrics_sql() + f" select metric, round(avg(x), 6) mean, count(*) n from ({rows}) group by 1",
        "term_verify": metrics_sql() + " select doc_id, reason = '' passed, reason from m",
        "token_overlap": overlap_sql() + " select doc_id, round(unigram_overlap, 6) unigram_overlap, round(bigram_overlap, 6) bigram_overlap from o",
        "embedding_cosine": "select a.vec_id, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 5) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
        "paragraphs_with_offsets": parts + " select doc_id, pos::int pos, start::int start, stop::int \"end\", md5(part) digest from q",
        "roundtrip": parts + """,
n as (select *, lead(start) over (partition by doc_id order by pos) nxt, min(start) over (partition by doc_id) lead from q),
y as (
  select doc_id, any_value(substr(t, 1, lead::bigint)) || string_agg(case when pos % 2 = 1 then '<p>' else part end || substr(t, (stop + 1)::bigint, (coalesce(nxt, length(t)) - stop)::bigint), '' order by pos) y
  from n group by 1)
select d.doc_id, md5(coalesce(y, t)) changed, true identical from d left join y using (doc_id)""",
        "merge_short_turns": f"""
with recursive c as (
  select conv_id, turn, row_number() over (partition by conv_id order by turn) k, coalesce(role = 'system', false) s, len({Q.spaced()}) w from conversations),
f as (
  select conv_id, k, case when s or w >= {C.MIN_PROSE} then 0 else w end run, case when s or w >= {C.MIN_PROSE} then [] else [turn] end open,
    case when not s and w >= {C.MIN_PROSE} then [{{'w': w, 'm': [turn]}}] else [] end done from c where k = 1
  union all
  select c.conv_id, c.k,
    case when c.s or c.w >= {C.MIN_PROSE} or f.run + c.w >= {C.MIN_PROSE} then 0 else f.run + c.w end,
    case when c.s or c.w >= {C.MIN_PROSE} or f.run + c.w >= {C.MIN_PROSE} then [] else list_append(f.open, c.turn) end,
    case when c.s or c.w >= {C.MIN_PROSE} then list_concat(f.done, case when len(f.open) > 0 then [{{'w': f.run, 'm': f.open}}] else [] end, case when not c.s then [{{'w': c.w, 'm': [c.turn]}}] else [] end)
      when f.run + c.w >= {C.MIN_PROSE} then list_append(f.done, {{'w': f.run + c.w, 'm': list_append(f.open, c.turn)}}) else f.done end
  from f join c on c.conv_id = f.conv_id and c.k = f.k + 1),
e as (select conv_id, case when len(open) > 0 then list_append(done, {{'w': run, 'm': open}}) else done end g from f qualify row_number() over (partition by conv_id order by k desc) = 1)
select conv_id, group_no, x.w words, array_to_string(x.m, ',') members from (select conv_id, unnest(range(1, len(g) + 1)) group_no, unnest(g) x from e)""",
        "skip_reason": policy_sql(),
        "token_windows": f"""
with d as (select doc_id, len({Q.spaced()}) n from documents), w as (select doc_id, n, unnest(range(0, greatest(ceil((n - {C.WINDOW}) / {C.STRIDE}.0), 0)::bigint * {C.STRIDE} + 1, {C.STRIDE})) start from d)
select doc_id, count(*) windows, max(start) last_start, round(avg(least({C.WINDOW}, n - start)), 6) mean_size from w group by 1""",
        "eval_cascade": cascade_sql() + " select * from x",
        "rejection_summary": cascade_sql() + " select stage, count(*) n, round(avg(similarity), 6) mean_similarity from x group by 1",
        "candidate_best": f"""
with recursive c as (select doc_id, i, 0.3::double + 0.7::double * {h('s')} score, 0.5::double + 0.1::double * {h('t')} sim from documents cross join range(0, 5) t(i)),
w as (
  select doc_id, i k, i, score, sim from c where i = 0
  union all
  select c.doc_id, c.i, case when {better} then c.i else w.i end, case when {better} then c.score else w.score end, case when {better} then c.sim else w.sim end
  from w join c on c.doc_id = w.doc_id and c.i = w.k + 1),
early as (select doc_id, min(i) i from c where score >= {C.SCORE_FLOOR} and score < 0.35 group by 1),
pick as (select w.doc_id, coalesce(early.i, w.i) i from w left join early using (doc_id) where k = 4)
select doc_id, i iteration, round(score, 6) score, round(sim, 6) sim from pick join c using (doc_id, i)""",
        "operator_choice": """
with a as (select doc_id::int i, doc_id % 8 p, (doc_id // 8) % 3 m, (doc_id // 24) % 6 f from documents),
b as (select *, case when m > 1 then ['STANDARD'] when m > 0 then ['STANDARD', 'RESTRUCTURE'] else ['STANDARD', 'RESTRUCTURE', 'VOICE_SHIFT', 'VOCABULARY', 'REORDER'] end x from a),
c as (select *, case when p > 5 then ['STANDARD', 'RESTRUCTURE'] when p > 3 then list_filter(x, lambda o: o <> 'REORDER') else x end y from b),
d as (select *, case when f >= 4 then ['STANDARD'] when f >= 2 then list_filter(y, lambda o: o in ('STANDARD', 'RESTRUCTURE')) else y end z from c)
select z[i % len(z) + 1] operator, count(*) n from d group by 1""",
        "resume_pending": "select lang, count(*) n from documents where doc_id not in (select doc_id from labels) group by 1",
    }


QUERIES = {
    f.__name__: f
    for f in (drift_metrics, metrics_long, term_verify, token_overlap, quick_similarity, quick_similarity_documents, embedding_cosine, paragraphs_with_offsets, roundtrip, merge_short_turns, skip_reason, token_windows, eval_cascade, rejection_summary, candidate_best, operator_choice, resume_pending)
}
