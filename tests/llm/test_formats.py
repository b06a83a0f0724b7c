"""Token alignment, chat formatting and fill-in-middle against plain versions and on edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import bpe, chat_format, entries, fill_middle, minhash_dedup, suffix_dedup, token_align, token_binary, words
from loomtext.llm.common import Table

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> x </s> <s> <0x41>"), (5, "other"), (6, "same same"), (6, "same same"), (None, "same same"),
    (7, "日本語 テキスト é ﬁ \0 \n\n  x"), (8, "a" * 5000 + " " * 3000 + "é" * 999), (9, "Thl" * 4000), (10, "one　two \x85 three"), (11, "<P> word"), (12, "tail  "), (13, "\n lead"),
]
CLASH = ("ids", "offset", "side", "digest", "copy", "pairs", "output", "form", "n", "row", "doc_id_id", "doc_id_text", "prefix_chars")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_all(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASH])


def sql_rows(name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}')")
    rel = c.sql(entries.oracle_sql()[name])
    return sorted(rel.columns), rel


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_fill_in_middle"])
def test_formats_match_sql(spark, name):
    names, rel = sql_rows(name)
    df = entries.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert by_all(df.select(*names).collect()) == by_all(rel.select(", ".join(names)).fetchall())


# Alignment


def plain_alignment(rows):
    """The columns of op11, one token after the other."""
    a_tool, b_tool = token_align.tool(0).tokenizer, token_align.tool(1).tokenizer
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    docs, holds = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            a_bytes = [bytes(back[c] for c in a_tool.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_tool.id_to_piece(i)[1:-1], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                i = j = x = y = 0
                mine, its = [], []
                while i < len(a) or j < len(b):
                    if x <= y:
                        x, i = x + len(a_bytes[i]), i + 1
                        mine.append(a[i - 1])
                    else:
                        y, j = y + len(b_bytes[j]), j + 1
                        its.append(b[j - 1])
                    if x == y:
                        groups.append((mine, its))
                        mine, its = [], []
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        holds.update(links.keys())
        docs.append((doc_id, groups, links))
    best = {}
    for (p, _), n in holds.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        counts = (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()))
        out.append((doc_id, *counts, sum(n for p, n in links.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in links.items()), sha(text) if groups else ""))
    return by_all(out)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = token_align.op11_token_align(spark, SF)
    assert got.columns == list(COLUMNS)
    assert by_all(got.collect()) == plain_alignment(rows)


@pytest.mark.parametrize(("bound", "block", "wide"), [(1 << 20, 1 << 14, 1 << 12), (20, 64, 4), (0, 7, 0)])
def test_alignment_of_odd_texts(odd, monkeypatch, bound, block, wide):
    """Blocks that cut documents, wide groups, and pairs beyond the broadcast: the same result."""
    monkeypatch.setattr(token_align, "BLOCK", block)
    monkeypatch.setattr(token_align, "WIDE", wide)
    rows = token_align.aligned(odd)
    assert by_all(token_align.scored(Table(rows).read(), bound).select(*COLUMNS).collect()) == plain_alignment(ODD)


def test_groups(odd):
    got = {}
    for r in sorted(token_align.groups(odd).filter("doc_id in (7, 8)").collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, groups in got.items():
        text = (" " + dict(ODD)[doc_id]).encode()
        assert groups[0].start == 0 and groups[-1].stop == len(text)
        for g, following in zip(groups, groups[1:]):
            assert g.stop == following.start
        for g in groups:
            for side, ids in ((0, g.a_ids), (1, g.b_ids)):
                assert token_align.tool(side).bytes.gather(np.array(ids)) == text[g.start : g.stop]
    assert token_align.groups(odd.filter("doc_id = 1")).count() == 0


def test_alignment_of_nothing(odd):
    rows = Table(token_align.aligned(odd.filter("doc_id < -1"))).read()
    assert rows.count() == 0 and token_align.scored(rows).count() == 0


# Chat formatting


def plain_messages(log):
    """Events in order of seq, applied one by one."""
    talks = {}
    for conv_id, seq, kind, turn, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2] == "delta")):
        turns = talks.setdefault(conv_id, {})
        if kind == "regenerate":
            for t in [t for t in turns if t > turn]:
                del turns[t]
            turns[turn] = [turns.get(turn, [""])[0], ""]
        elif kind == "message":
            turns[turn] = [role or "", text or ""]
        elif kind == "edit":
            turns[turn] = [role or turns.get(turn, [""])[0], text or ""]
        else:
            was = turns.get(turn, ["", ""])
            turns[turn] = [role or was[0], was[1] + (text or "")]
    return {c: [tuple(turns[t]) for t in sorted(turns)] for c, turns in talks.items()}


LOG = [
    (1, 1, "message", 0, "user", "hello"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "Hi"), (1, 4, "delta", 1, None, " there"),
    (1, 5, "message", 2, "user", "more"), (1, 6, "delta", 3, "assistant", "lost"), (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "Again"),
    (1, 9, "edit", 0, None, "hello [INST]"), (1, 10, "message", 2, "user", "</s> next"),
    (2, 1, "message", 0, "system", None), (2, 2, "edit", 0, None, "rules"), (2, 3, "message", 1, "assistant", "x"), (2, 4, "edit", 1, None, "y"), (2, 5, "delta", 1, None, "z"),
    (3, 1, "message", 0, "user", "a"), (3, 2, "message", 1, "assistant", "b"), (3, 3, "message", 2, "user", "c"), (3, 4, "regenerate", 0, None, None),
]
LOG_SCHEMA = "conv_id long, seq long, kind string, turn long, role string, text string"


def read_back(rows):
    return {r.conv_id: [tuple(t) for t in r.turns] for r in rows.withColumn("turns", chat_format.parsed(chat_format.whole_text(F.col("segments")))).collect()}


def test_events_are_folded(spark):
    log = spark.createDataFrame(LOG + LOG[3:4], LOG_SCHEMA).repartition(3).withColumn("segments", F.lit(1)).withColumn("dropped", F.lit(2))
    assert read_back(chat_format.formatted(log)) == plain_messages(LOG)
    assert chat_format.formatted(log.filter("conv_id > 9")).count() == 0


def test_random_logs(spark):
    rng = np.random.default_rng(8)
    log = []
    for conv in range(60):
        for seq in range(int(rng.integers(1, 25))):
            kind = ("message", "delta", "delta", "edit", "regenerate")[rng.integers(5)]
            role = (None, "user", "assistant")[rng.integers(3)] if kind == "message" else None
            role = role or ("user" if kind == "message" else None)
            log.append((conv, seq, kind, int(rng.integers(4)), role, None if kind == "regenerate" else "abc"[: rng.integers(4)] + str(seq)))
    df = spark.createDataFrame(log, LOG_SCHEMA).repartition(4)
    got = {c: [] for c in plain_messages(log)}
    for r in sorted(chat_format.messages(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        got[r.conv_id].append((r.role, r.text))
    want = plain_messages(log)
    assert {c: [t for _, t in x] for c, x in got.items()} == {c: [t for _, t in x] for c, x in want.items()}


def test_escapes_and_loss(spark):
    texts = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> <s", "<", "[/INST", None, "", "a" * 1000 + "\n<s>" * 50, "[/INST]</s>", "日本 <s>"]
    rows = [(k, i, role, t) for k in range(2) for i, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", None, "a<s>b"))]
    rows += [(None, 0, "assistant", "x"), (5, None, "assistant", "first"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "a tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    out = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(chat_format.streamed(df, piece=7))).collect()}
    lowest = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple(map(lowest, r[1:])))
        learned = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_template_is_native(spark):
    plan = chat_format.op12_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text("ab é日\U0001f600 \t\n<PSM>", max_size=60), st.integers(-5, 400), st.integers(1, 5))
def test_cuts(text, doc_id, stride):
    n, form, before, middle, raw = fill_middle.transform(text, doc_id, stride=stride)
    assert (n, form, before, middle, raw.decode()) == plain_fim(doc_id, text)
    assert fill_middle.restored(raw, form).decode() == text


def test_fill_middle(odd):
    got = by_all(fill_middle.transformed(odd).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    assert got == by_all((d, *plain_fim(d, t)) for d, t in ODD)
    kept = fill_middle.fill_middle(odd)
    assert kept.columns == odd.columns
    assert by_all(kept.collect()) == by_all((d, plain_fim(d, t)[-1], *[1] * len(CLASH)) for d, t in ODD)
    assert fill_middle.transformed(odd.filter("doc_id < -1")).count() == 0


# Words that polynomial hashes cannot tell apart


def thue_morse(size, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(size))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_are_told_apart(spark, size):
    one, other = thue_morse(size, "ab"), thue_morse(size, "ba")
    points = np.frombuffer((one + other + one).encode("utf-32-le"), np.uint32)
    starts, ends = np.array([0, size, 2 * size]), np.array([size, 2 * size, 3 * size])
    values = np.arange(1, 300, dtype=np.uint64)[points]
    name = words.names(values, starts, ends)
    first, number = words.distinct(points, starts, ends, name)
    assert number[0] == number[2] != number[1] and len(first) >= 2
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in minhash_dedup.near_duplicates(df).collect()}
    assert [out[k].component_id for k in (1, 2, 3)] == [1, 2, 1]
    tool = token_binary.library_encoder(bpe.tokenizer_file("byte_bpe_50k.json"))
    for text, ids in zip((one, other, one), tool.encode_all([one, other, one]), strict=True):
        assert ids.tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids
    raw, first = [t.encode() for t in (one, other, one)], {}
    for i, t in enumerate(raw):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for r in suffix_dedup.repeated(df).collect():
        t, gone = raw[r.doc_id - 1], bytearray(size)
        for k in range(size - 49):
            if first[t[k : k + 50]] < r.doc_id - 1:
                gone[k : k + 50] = b"\1" * 50
        assert r.n_removed == sum(gone) and r.kept_sha256 == hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "abcdefgh", "abcdefghi", "abcdefgi", "é", "日本", "x" * 17, "x" * 16 + "y", "\0", "a\0"]), max_size=12), st.integers(1, 3), st.sampled_from([np.uint8, np.uint16, np.uint32]))
def test_words_by_content(some, kinds, unit):
    """Names that say little: the characters decide."""
    code = {np.uint8: "utf-8", np.uint16: "utf-16-le", np.uint32: "utf-32-le"}[unit]
    raw = [w.encode(code) for w in some]
    units = np.frombuffer(b"".join(raw), unit)
    ends = np.cumsum([len(r) // unit().itemsize for r in raw], dtype=np.int64)
    starts = ends - [len(r) // unit().itemsize for r in raw] if raw else ends
    first, number = words.distinct(units, starts, ends, np.array([sum(r) % kinds for r in raw], np.uint64))
    assert [some[first[n]] for n in number] == some
    assert all((number[i] == number[j]) == (some[i] == some[j]) for i in range(len(some)) for j in range(i))
