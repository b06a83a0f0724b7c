"""The pipeline's stages against plain versions, and the SQL that the other tests leave out."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from test_library import SF, SLOW, duck, normal  # noqa: F401

import corpus_pipeline
from loomtext.llm import entries, minhash_dedup, quality_rules, source_mixing, suffix_dedup
from loomtext.llm.common import finish
from loomtext.plans import catalogue

EXTRA = sorted(SLOW | set(entries.oracle_sql()))


@pytest.mark.parametrize("name", EXTRA)
def test_slow_and_operator_queries_match_sql(spark, duck, name):  # noqa: F811
    df = (catalogue.queries() | entries.queries())[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql((catalogue.oracle_sql() | entries.oracle_sql())[name])
    assert sorted(rel.columns) == names
    want = normal(rel.select(", ".join(f'"{n}"' for n in names)).fetchall())
    assert normal(df.select(*[f"`{n}`" for n in names]).collect()) == want


def plain_quality(rows):
    q, counts = quality_rules, []
    for r in rows:
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = defaultdict(list)
        for k in range(len(ws) - q.WINDOW + 1):
            places[tuple(ws[k : k + q.WINDOW])].append(k)
        again = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(q.WINDOW)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(q.SYMBOLS, t)), "n_lines": len(ls)}
        c |= {"n_dup_lines": len(ls) - len(set(ls)), "n_repeat_words": len(again)}
        if len(ws) >= q.MIN_WORDS and 100 * len(again) <= q.MAX_REPEAT * len(ws):
            counts.append((r, c))
    bucket = lambda x: x >> max(x.bit_length() - q.BITS, 0) << max(x.bit_length() - q.BITS, 0)
    out = {id(r): r for r, _ in counts}
    for top, bottom, scale, low, high in q.RATES.values():
        values = [(r, bucket(c[top] * scale // c[bottom])) for r, c in counts]
        own, langs, whole = defaultdict(Counter), defaultdict(Counter), Counter()
        for r, v in values:
            own[r.lang, r.source][v] += 1
            langs[r.lang][v] += 1
            whole[v] += 1
        mixed = lambda mine, parent: Counter({v: mine[v] * parent.total() + q.PRIOR * parent[v] for v in {*mine, *parent}})
        for r, v in values:
            of = mixed(own[r.lang, r.source], mixed(langs[r.lang], whole))
            at = lambda p: next(v for v, upto in zip(sorted(of), accumulate(of[v] for v in sorted(of))) if upto * 1000 >= of.total() * p)
            some = Counter({x: n for x, n in of.items() if x > 0})
            over = lambda p: next(v for v, upto in zip(sorted(some), accumulate(some[v] for v in sorted(some))) if upto * 1000 >= some.total() * p)
            upper = at(high) + q.STRETCH * (at(high) - at(500)) if at(high) or not some else over(q.SOME) // 2
            if high and v > upper or low and v < at(low) - q.STRETCH * (at(500) - at(low)):
                out.pop(id(r), None)
    return [(r.doc_id, r.text) for r in out.values()]


def plain_near_copies(rows):
    sets = {r.doc_id: minhash_dedup.shingle_set(r.text) for r in rows}
    group = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return [(r.doc_id, r.text) for r in rows if group[r.doc_id] == r.doc_id]


def plain_cut(rows):
    raw = {r.doc_id: (r.text or "").encode() for r in rows}
    first, out = {}, []
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        if not t or sum(gone) < len(t):
            text = bytes(c for c, g in zip(t, gone) if not g).decode(errors="replace")
            out.append((i, text, len(text)))
    return out


def plain_mix(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    place = lambda r: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
    total = Counter()
    for r in rows:
        total[r.source] += size(r)
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: source_mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, of, level = source_mixing.SHARE * sum(total.values()), sum(weight.values()), 0.0
    for s in sorted(order, key=lambda s: (source_mixing.CAP * total[s] / weight[s], order.index(s))):
        level = max(level, left / of)
        left, of = left - source_mixing.CAP * total[s], of - weight[s]
    out = []
    for s in order:
        target, mine = min(source_mixing.CAP * total[s], level * weight[s]), sorted((r for r in rows if r.source == s), key=place)
        times = int(target // total[s]) if total[s] else 0
        budget, upto, last = target - times * total[s], 0, -1
        for r in mine:
            upto += size(r)
            if upto > budget:
                last = place(r) if upto - budget < budget - (upto - size(r)) else place(r) - 1
                break
        for r in mine:
            out += [(r.doc_id, r.text)] * (times + (place(r) <= last))
    return out


def plain_tokens(rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out.append((r.doc_id, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def with_odd_rows(docs):
    """docs and rows with a null in each column and with an empty text."""
    one = docs.filter("doc_id = 7")
    odd = [one.withColumn(c, F.lit(None).cast(docs.schema[c].dataType)).withColumn("doc_id", F.lit(10_000_000 + k).cast("long")) for k, c in enumerate(("text", "lang", "source", "n_chars"))]
    for more in (*odd, one.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10_000_009).cast("long"))):
        docs = docs.union(more)
    return docs


STAGES = [("doc_id, text", plain_quality), ("doc_id, text", plain_near_copies), ("doc_id, text, n_chars", plain_cut), ("doc_id, text", plain_mix), ("doc_id, n_tokens, decoded_sha256", plain_tokens)]


def test_pipeline_stages(spark, tmp_path):
    with_odd_rows(spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(f"{tmp_path}/in/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for number, (names, plain) in enumerate(STAGES):
        name, stage = corpus_pipeline.STAGES[number]
        result = stage(spark, docs, f"{tmp_path}/in")
        result.write.parquet(f"{tmp_path}/{number}")
        finish(result)
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        got, want = sorted(map(tuple, docs.select(*names.split(", ")).collect())), sorted(plain(before))
        assert got == want, name
        assert 0 < len(got) and (number == 4 or docs.columns == columns)
        before = docs.collect()
    out = corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, before))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < -1").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_leaves_nothing(spark, tmp_path):
    from pathlib import Path

    from loomtext.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    corpus_pipeline.run(spark, SF).count()
    assert not [x for x in set(shared.iterdir()) - before if x.name.startswith(("table-", "pipeline-"))]
    assert not spark.catalog.listTables()


def test_two_pipelines_in_one_session(spark):
    """Results that are written later keep their tables while others are finished."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = suffix_dedup.deduplicated(docs), suffix_dedup.deduplicated(docs)
    want = sorted(map(str, first.collect()))
    finish(first)
    corpus_pipeline.run(spark, SF).count()
    assert sorted(map(str, second.collect())) == want
    finish(second)
    assert not spark.catalog.listTables()
