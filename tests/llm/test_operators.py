"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, language_id, license_scan, minhash_dedup, quality_rules, source_mixing, suffix_dedup, token_binary, topk_search, url_filter
from loomtext.llm.common import finish

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "gone", "_gone", "_kept_id", "_kept", "_repeats", "_last", "_salt", "_r_source", "repeats", "last", "doc_at", "n_bytes", "n_removed", "kept_text", "size", "n", "h", "doc", "a", "b", "key", "place", "rank", "least", "low", "shared", "of", "copy", "kept", "bands", "target", "rate", "w", "s", "p", "lines", "again", "_times", "bucket")


def texts():
    rng = random.Random(5)
    words = ["river", "stone", "quiet", "harbour", "lantern", "meadow", "signal", "copper", "winter", "garden", "letter", "bridge", "ocean", "candle", "forest", "window"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    shared = prose(20)
    near = base.split()
    near[30] = "changed"
    return [
        None, "", " \n\t ", "one", "one two", "one two", base, base, " ".join(near), prose(80) + " " + shared + " " + prose(30), shared + "\n" + prose(50),
        "line again and again here now\n" * 30, "Straße müßig übel größer. " * 12, "El niño come año mañana señor. " * 10, prose(4000), "x" * 500, "##$$ %%& || <> " * 20,
        "Released under the MIT License and the Apache License, see GNU General Public License.", "日本語のテキスト " * 12, "<|endoftext|> tail <|startoftext|>", base.upper(),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    langs, sources = ["en", "de", None, "es"], ["s1", "s1", "s1", None, "s2", "s3"]
    rows = [(i, t, langs[i % 4], sources[i % 6], len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(1).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -1")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(docs, empty):
    out = by_id(quality_rules.judge(docs))
    assert len(out) == len(texts())
    for i, t in enumerate(texts()):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places = defaultdict(list)
        for k in range(len(ws) - 4):
            places[tuple(ws[k : k + 5])].append(k)
        again = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(5)}
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(again), len(ls) - len(set(ls))), i
        assert r.base_failed == (len(ws) < 10 or 100 * len(again) > 20 * len(ws))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if out[r.doc_id].kept)


def test_fences_follow_the_sketches(spark):
    """Two sources with different habits: what is usual in one is rejected in the other, and each rate's fence rejects its outlier."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    plain = lambda n=60: [word(rng.choice((4, 5, 6))) for _ in range(n)]
    with_symbols = lambda: [w + "#" * (k % 3 == 0) for k, w in enumerate(plain())]
    rows = [(i, " ".join(plain()), "en", "prose") for i in range(400)] + [(400 + i, " ".join(with_symbols()), "en", "code") for i in range(100)]
    rows += [(900, " ".join(with_symbols()), "en", "prose"), (901, " ".join(word(11) for _ in range(60)), "en", "prose"), (902, " ".join(word(2) for _ in range(60)), "en", "prose")]
    rows += [(903, "\n".join(" ".join(plain(9)) + "\nsame" for _ in range(20)), "en", "prose")]
    t = plain(100)
    rows += [(904, " ".join(t + t[:9]), "en", "prose")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = by_id(quality_rules.judge(df))
    assert not any(out[i].base_failed for i in out)
    assert [i for i in range(900, 905) if out[i].kept] == []
    assert sum(out[i].kept for i in range(500)) > 485
    fences = {(r.source, name): r[f"{name}_upper"] for r in out.values() for name in quality_rules.RATES}
    assert fences["code", "symbol_rate"] > fences["prose", "symbol_rate"]
    # A small source takes its language's fences.
    few = by_id(quality_rules.judge(df.withColumn("source", F.when(F.col("doc_id") % 100 == 3, "rare").otherwise(F.col("source")))))
    assert few[3].symbol_rate_upper > few[4].symbol_rate_upper


def test_rare_symbols_are_no_fault(spark):
    """Sources in which nearly all texts have no symbols: strays stay, junk goes, and how much is junk follows the source."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() + ("#" if k < n else "") for k in range(200))
    rows = [(1000 * s + i, text(0), "en", f"s{s}") for s in (0, 1) for i in range(900)]
    rows += [(1000 * s + 900 + i, text(junk + i % 7), "en", f"s{s}") for s, junk in ((0, 60), (1, 180)) for i in range(60)]
    rows += [(1000 * s + 980 + i, text(6), "en", f"s{s}") for s in (0, 1) for i in range(2)]
    out = by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    for s in (0, 1):
        assert all(out[1000 * s + 980 + i].kept for i in range(2))
        assert not any(out[1000 * s + 900 + i].kept for i in range(60))
    assert 0 < out[0].symbol_rate_upper < out[1000].symbol_rate_upper


def test_mixing(docs, empty):
    rows = source_mixing.plan_mix(docs).collect()
    total = sum(r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 4000 for s in target)
    again = sorted(map(tuple, source_mixing.plan_mix(docs).collect()))
    assert again == sorted(map(tuple, rows))
    assert source_mixing.plan_mix(empty).count() == 0
    mixed = source_mixing.mix(docs)
    assert mixed.columns == docs.columns
    want, whole = [], {r.doc_id: str(r) for r in docs.collect()}
    for r in rows:
        if r["size"]:
            want += [whole[r.doc_id]] * (r.taken // r["size"])
    assert sorted(x for x in map(str, mixed.collect()) if x in want) == sorted(want)


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    host = lambda: ".".join(name() for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + name() for _ in range(rng.randint(0, 3))) + rng.choice(("", "/"))
    rules = [(host() + (path() or "/"), rng.choice(("allow", "block"))) for _ in range(60)]
    pages = spark.createDataFrame([(i, "h://" + host() + path()) for i in range(300)], "page_id long, url string")
    want = sorted(map(str, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES", 10)
    assert sorted(map(str, url_filter.judge(pages, rules).collect())) == want
    fits = lambda r, h, p: (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])
    for r in url_filter.judge(pages, rules).collect():
        best = max(((x.partition("/")[0].count("."), len(x), v == "block") for x, v in rules if fits(x, r.host, r.path)), default=None)
        assert (best is None) == (r.rule is None) and (best is None or (r.rule.partition("/")[0].count("."), len(r.rule), r.verdict == "block") == best)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.example.net/en/x", "http://example.net/en", "HTTPS://EXAMPLE.NET/fr", "http://x.net", "http://x.net/?q", "ftp://b.org/fr/", "http://org/fr/1", "http://myexample.com/de/", "http://Example.com/de/a://b", "x://#", "http://a.b?c/d"]
    pages = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    tree = sorted(map(str, url_filter.judge(pages).collect()))
    assert tree == sorted(map(str, url_filter.judge_by_join(pages, rules).collect()))
    out = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert (out[3].rule, out[3].verdict) == ("example.net/en/", "allow")
    assert (out[4].rule, out[4].verdict) == ("net/", "block")
    assert out[6].rule is None and out[6].verdict == "allow"  # an empty path does not start with a slash
    assert out[9].rule == "org/fr/" and out[10].rule is None and out[11].rule == "example.com/de/"
    assert url_filter.judge(pages.filter("page_id < 0")).count() == 0
    assert url_filter.longest(url_filter.build_trie([("a.b/x", "allow"), ("b/x/y", "block"), ("a.b/x", "block")]), "a.b", "/x/y") == ("a.b/x", "block")


def test_language(docs, empty, spark):
    out = by_id(language_id.predict(docs, language_id.prototypes(docs)))
    for i, t in enumerate(texts()):
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), i
        assert 0 <= out[i].score <= 1
    nothing = by_id(language_id.predict(docs, language_id.prototypes(empty)))
    assert {r.lang_pred for r in nothing.values()} == {"und"}
    # The vector of a text is the sum of its grams' products.
    row, gram, count, _ = language_id.gram_counts(["ab"])
    two, one, none = language_id.letter_vectors()
    assert [(g, c) for g, c in zip(gram, count)] == [(1 * 64 + 2, 1), (1 * 4096 + 2 * 64, 1)]
    assert (language_id.gram_vectors(gram)[0] == two[0] * one[1] * none[2]).all()


def test_language_holds_out():
    import duckdb

    rows = duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet' where length(text) > 200").fetchall()
    learned = {}
    for k in sorted({x for _, x in rows}):
        _, g, c, _ = language_id.gram_counts([t for t, x in rows[::2] if x == k])
        v = (c[:, None] * language_id.gram_vectors(g)).sum(axis=0)
        learned[k] = v / np.linalg.norm(v)
    good = 0
    for t, x in rows[1::2]:
        _, g, c, _ = language_id.gram_counts([t])
        v = c @ language_id.gram_vectors(g)
        good += max(learned, key=lambda k: v @ learned[k]) == x
    assert good / len(rows[1::2]) > 0.97


def plain_grams(text):
    """Counts of letter grams, one character at a time."""
    low = [k for k in language_id.letter_classes()[[ord(c) for c in text]].tolist()] if text else []
    kinds = [0]
    for k in [*low, 0]:
        if k or kinds[-1]:
            kinds.append(k)
    if kinds[-1]:
        kinds.append(0)
    found = defaultdict(int)
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        if b:
            found[a, b, c] += 1
    return found


def test_language_query_against_a_plain_version(spark, tmp_path):
    """Which rows are learned from, the bundles, the cosines and the held-out mark."""
    rng = random.Random(12)
    words = {"en": ["the", "house", "with", "quick"], "de": ["der", "Häuser", "mit", "schön"], "fr": ["les", "maisons", "été", "où"]}
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr", None)[i % 4]
        rows.append((i, " ".join(rng.choice(words[lang or "en"]) for _ in range(rng.randint(3, 12))), lang, "s"))
    rows += [(200, None, "en", "s"), (201, "", "de", None), (202, "12 34 !!", "fr", "s"), (203, "ß", "de", "s"), (3, "the house", "fr", "s")]
    # Held-out rows carry false languages: whoever learns from them goes wrong.
    rows = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 and lang else lang, s) for i, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    two, one, none = language_id.letter_vectors().astype(int)
    vector = lambda g: sum((n * two[a] * one[b] * none[c] for (a, b, c), n in g.items()), np.zeros(language_id.SIZE, int))
    learned = {}
    for i, t, lang, _ in rows:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang] = learned.get(lang, 0) + vector(plain_grams(t))
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in language_id.op2_language_id(spark, str(tmp_path)).collect())
    want = []
    for i, t, _, _ in rows:
        v = vector(plain_grams(t))
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sorted(learned.items())} if v.any() else {}
        best = max(cosines, key=cosines.get) if cosines else "und"
        want.append((i, zlib.crc32(str(i).encode()) % 4 == 2, best, round(max(cosines.get(best, 0), 0), 4)))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(got, sorted(want)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path(name)), bpe.encoder(P.path(name))
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), *range(0x2000, 0x2100), *range(0x3040, 0x3100), *range(0x1F600, 0x1F640)]]
    more = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["İstanbul ΣΑΣ", "'s 'S WE'LL", "ab" * 700]
    for t in [x or "" for x in texts()] + more:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t[:80]
        assert own.decode(own.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)


def test_letters_without_a_token():
    from tokenizers import Tokenizer, models

    vocab = {t: i for i, t in enumerate(["a", "b", "c</w>", "b</w>", "ab", "abc</w>"])}
    merges = [("a", "b"), ("ab", "c</w>")]
    library = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix="</w>"))
    own = bpe.Merges(vocab, merges, "</w>")
    for word in ("abc", "axbc", "abx", "xab", "axxb", "x", "abxc"):
        assert own.encode(word) == library.encode(word).ids, word


def test_bpe_rows(docs, empty):
    out = by_id(bpe.encode_decode(docs))
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))), i
    assert len(out) == len(texts()) and bpe.encode_decode(empty).count() == 0


def test_near_duplicates(docs, empty):
    out = by_id(minhash_dedup.near_duplicates(docs.union(docs.filter("doc_id = 6"))))
    sets = {i: minhash_dedup.shingle_set(t) for i, t in enumerate(texts())}
    group = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                old, new = sorted((group[i], group[j]))[::-1]
                group = {k: new if g == old else g for k, g in group.items()}
    for i in sets:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(sets[i]), group[i], group[i] == i), i
    assert minhash_dedup.near_duplicates(empty).count() == 0
    left = minhash_dedup.near_dedup(docs)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if out[r.doc_id].kept)


def test_many_near_copies(spark):
    """A large group whose members differ from each other: every one is found, and none that is not linked."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for k in rng.sample(range(200), 3):
            t[k] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(t)))
    out = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [out[i].component_id for i in range(300)] == plain_components([minhash_dedup.shingle_set(t) for _, t in rows])


@pytest.mark.parametrize(("small", "rare"), [(2, 4), (2, 1), (minhash_dedup.SMALL, minhash_dedup.RARE)])
def test_group_at_the_limit(spark, monkeypatch, small, rare):
    """A large group with members on both sides of the limit and edits that recur: buckets stay open and what is left decides."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "RARE", rare)
    rng = random.Random(9)
    base, rows = [f"w{rng.randrange(9999)}" for _ in range(150)], []
    for i in range(260):
        t = list(base)
        for k in rng.sample(range(150), rng.randint(0, 8)):
            t[k] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(t[rng.choice((0, 0, 4)) : rng.choice((150, 146))])))
    out = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [out[i].component_id for i in range(260)] == plain_components([minhash_dedup.shingle_set(t) for _, t in rows])


def plain_components(sets):
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, 400, np.uint64)
    for share in (0.3, 0.75, 0.95):
        k = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(1, 2**63, 400 - k, np.uint64)])
        same = (minhash_dedup.sketch(a) == minhash_dedup.sketch(b)).mean()
        assert abs(same - len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))) < 0.1
    assert len(set(minhash_dedup.sketch(a[:1]).tolist())) == minhash_dedup.COORDINATES


def test_token_files(docs, empty, spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    files = token_binary.write(docs)
    out, at = by_id(token_binary.read(files.read())), 0
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [token_binary.END]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    some = {r.doc_id: r.ids for r in token_binary.document_ids(files.read(), docs.filter("doc_id in (0, 9, 14, 20)").select("doc_id")).collect()}
    assert some == {i: library.encode(texts()[i] or "", add_special_tokens=False).ids + [token_binary.END] for i in (0, 9, 14, 20)}
    files.drop()
    assert token_binary.read(token_binary.write(empty).read()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(0, 3000))
    ids = [rng.integers(0, 50_000, size), rng.integers(0, 2**32, size), np.full(size, 2**32 - 1), np.where(rng.random(size) < 0.05, 2**32 - 1, rng.integers(0, 9, size))][seed % 4].astype(np.uint32)
    payload = token_binary.pack(ids)
    assert (token_binary.unpack(payload) == ids).all()
    for _ in range(5):
        a, b = sorted(int(x) for x in rng.integers(0, size + 1, 2))
        assert (token_binary.unpack(payload, a, b) == ids[a:b]).all()


def test_words_are_cut_as_the_library_does():
    import public_tokenizers as P

    tool, rng = token_binary.LibraryEncoder(P.path("byte_bpe_50k.json")), random.Random(3)
    pool = "aé bß1²9 '  \n\tsdmtlvre\"-.\x85\u0130日"
    more = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in texts()] + ["", "it's", "'sword 'll'llama", " 's ''s"]
    assert [x.tolist() for x in tool.encode_all(more)] == [x.ids for x in tool.tokenizer.encode_batch(more, add_special_tokens=False)]


def test_licenses(docs, empty):
    out = by_id(license_scan.scan(docs))
    for i, t in enumerate(texts()):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(hits), ",".join(sorted({x for _, x in hits}))), i
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert 0 <= r.score <= 1
    assert license_scan.scan(empty).count() == 0


def test_license_templates():
    index = license_scan.Index({w: 0 for w in license_scan.vocabulary()}, 100_000)
    for text, _, label in license_scan.TEMPLATES:
        words = ("some words before " + text + " and after").encode().split()
        *_, labels, score = index.scan(words)
        assert label in labels.split(",") and score == 1.0
    assert index.scan(b"permission is granted free to use this software".split())[4] == ""


def test_common_notices():
    index = license_scan.Index({w: 40_000 for w in license_scan.vocabulary()}, 100_000)
    for text, _, label in license_scan.TEMPLATES:
        *_, labels, score = index.scan(("some words before " + text + " and after").encode().split())
        assert label in labels.split(",") and score == 1.0


@pytest.mark.parametrize("rare", range(len(license_scan.TEMPLATES)))
def test_all_notices_in_one_text(rare):
    first = license_scan.TEMPLATES[rare][0].encode().split()
    index = license_scan.Index({w: 1 if w in first else 100 for w in license_scan.vocabulary()}, 100_000)
    *_, labels, score = index.scan(" and ".join(t for t, _, _ in license_scan.TEMPLATES).encode().split())
    assert labels.split(",") == sorted(label for _, _, label in license_scan.TEMPLATES) and score == 1.0


def test_license_table_against_a_plain_version(spark):
    """Labels and score of every row of a table in which all texts hold one notice and some hold others, whole or in part."""
    rng, rows = random.Random(10), []
    common = license_scan.TEMPLATES[0][0]
    for i in range(150):
        parts = [rng.choice(license_scan.TEMPLATES)[0].split() for _ in range(rng.randint(0, 3))]
        parts = [" ".join(w if rng.random() > 0.03 else "other" for w in p[rng.choice((0, 0, 4)) :]) for p in parts]
        rows.append((i, "; ".join(["Some words", common.upper(), *parts, rng.choice(("", "CC-BY, MIT License", "cc by"))])))
    out = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        ws, best, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()), 0.0, set()
        for text, phrase, label in [(p, p, x) for p, x in license_scan.BASE.items()] + list(license_scan.TEMPLATES):
            full, key = text.split(), phrase.split()
            at = next(k for k in range(len(full)) if full[k : k + len(key)] == key)
            for k in range(len(ws)):
                there = sum(k - at + n in range(len(ws)) and ws[k - at + n] == w for n, w in enumerate(full)) / len(full)
                if ws[k : k + len(key)] == key and there >= license_scan.LEAST:
                    labels.add(label)
                    best = max(best, there)
        assert "mit" in labels and (out[i].labels, out[i].score) == (",".join(sorted(labels)), best), i


def test_places_are_intersected():
    index = license_scan.Index({w: 0 for w in license_scan.vocabulary()}, 100_000)
    number = next(i for i, x in enumerate(index.templates) if x[3] == "mpl")
    found = lambda text: {w: [i for i, x in enumerate(text.encode().split()) if x == w] for w in index.phrases[number]}
    text, phrase, _ = next(x for x in license_scan.TEMPLATES if x[2] == "mpl")
    assert index.starts(number, found(f"mozilla {text} mozilla {text}")) == {1, 2 + len(text.split())}
    assert index.starts(number, found(" ".join(reversed(phrase.split())))) == set()


def test_places_against_all_starts():
    rng = random.Random(8)
    for _ in range(200):
        parts = [rng.choice(license_scan.TEMPLATES)[0].split() for _ in range(rng.randint(1, 4))]
        words = [w for p in parts for w in p[rng.choice((0, 0, 3)) : rng.choice((None, None, -4))] if rng.random() > 0.01]
        ws, best, labels = [w.encode() for w in words], 0.0, set()
        for text, phrase, label in [(p, p, x) for p, x in license_scan.BASE.items()] + list(license_scan.TEMPLATES):
            full, key = text.encode().split(), phrase.encode().split()
            at = next(i for i in range(len(full)) if full[i : i + len(key)] == key)
            for k in range(len(ws)):
                there = sum(k - at + n in range(len(ws)) and ws[k - at + n] == w for n, w in enumerate(full)) / len(full)
                if ws[k : k + len(key)] == key and there >= license_scan.LEAST:
                    labels.add(label)
                    best = max(best, there)
        index = license_scan.Index({w: rng.randrange(90_000) for w in license_scan.vocabulary()}, 100_000)
        assert index.scan(ws)[4:] == (",".join(sorted(labels)), best)


@pytest.mark.parametrize(("block", "queries"), [(topk_search.BLOCK, topk_search.QUERIES), (40, 3)])
def test_search(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (350, [float("nan")] * 4, 1), (400, [float("inf"), 0.0, 0.0, 0.0], 1), (302, [0.5], 1), (None, [1.0] * 4, 1), (100, rows[100][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    v = df.select("vec_id", topk_search.scaled(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    got = topk_search.search(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    ok = [(i, np.floor(256 * np.pad(np.array(e, float), (0, 4 - len(e)))).astype(int)) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = set()
    for q, x in {i: x for i, x in ok if i % 50 == 0}.items():
        best = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert set(map(tuple, got.collect())) == want
    assert topk_search.search(v.filter("vec_id < 0"), v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))).count() == 0


def test_repeats(docs, empty):
    out = by_id(suffix_dedup.repeated(docs))
    raw = [(t or "").encode() for t in texts()]
    first = {}
    for i, t in enumerate(raw):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()), i
    assert suffix_dedup.repeated(empty).count() == 0
    cut = suffix_dedup.deduplicated(docs)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    got = cut.collect()
    assert {r.doc_id for r in got} == {i for i in out if not out[i].n_removed or out[i].n_removed < out[i].n_bytes}
    for r in got:
        assert {c: r[c] for c in docs.columns if c != "text"} == {c: rows[r.doc_id][c] for c in docs.columns if c != "text"}
        assert out[r.doc_id].n_removed or (r.text or "") == (rows[r.doc_id].text or "")
    finish(cut)
    assert not docs.sparkSession.catalog.listTables()


def test_anchor_with_many_neighbourhoods(spark, monkeypatch):
    """A passage with other words around it in each document: as one group, in parts, and window by window."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcde ") for _ in range(5)) for _ in range(n))
    passage = words(14)
    rows = [(i, words(8) + passage[rng.randrange(9) :] + words(8)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sorted_ = sorted(map(tuple, suffix_dedup.repeated(df).collect()))
    for many in (0, 3, 20):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        assert sorted(map(tuple, suffix_dedup.repeated(df).collect())) == sorted_
    assert sum(r[2] for r in sorted_) > 59 * 50


def test_window_order():
    rng = random.Random(3)
    for _ in range(20):
        base = bytes(rng.choice(b"ab c\0z") for _ in range(200))
        strings = [base[(k := rng.randrange(150)) : k + rng.randrange(20, 84)] + b"a" * rng.choice((0, 0, 40)) for _ in range(40)]
        owners = np.array([rng.randrange(10) for _ in strings])
        first = {}
        for s, d in zip(strings, owners):
            for k in range(len(s) - 49):
                first[s[k : k + 50]] = min(first.get(s[k : k + 50], 99), d)
        whose, start = suffix_dedup.window_masks(strings, owners)
        assert set(zip(whose.tolist(), start.tolist())) == {(i, k) for i, (s, d) in enumerate(zip(strings, owners)) for k in range(len(s) - 49) if first[s[k : k + 50]] < d}


def test_languages_in_several_blocks(spark, monkeypatch):
    """Languages that one block does not hold: the same predictions."""
    rng = random.Random(13)
    sounds = {f"l{k}": [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") for _ in range(6)] for k in range(7)}
    rows = [(i, " ".join(rng.choice(sounds[f"l{i % 7}"]) for _ in range(20)), f"l{i % 7}") for i in range(140)] + [(200, None, None), (201, "1 2", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.prototypes(df)
    one = by_id(language_id.predict(df, learned))
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert len(list(language_id.blocks(learned))) > 1
    several = by_id(language_id.predict(df, learned))
    assert {i: (r.lang_pred, round(r.score, 5)) for i, r in several.items()} == {i: (r.lang_pred, round(r.score, 5)) for i, r in one.items()}
    assert one[200].lang_pred == one[201].lang_pred == "und" and one[3].lang_pred == "l3"
