"""Near-duplicate documents: fast similarity sketches, banding, and exact verification.

A text's set holds its distinct five-word shingles. The sketch has COORDINATES bins. In round i every shingle is hashed anew to a bin
and a value; a bin keeps the least value of the first round that reaches it. After COORDINATES rounds each bin still empty has a round
of its own in which all shingles fall into it. So all coordinates are filled, after few rounds for large sets, and they agree with
probability and concentration as needed for banding: two sets with similarity 0.75 share none of the 46 bands of 5 coordinates with
probability 4e-6.

Texts with equal sets are one class, found by a fingerprint of 128 bits. Its parts are digests of words, which are told apart by their
bytes, so no polynomial hash stands for identity; only its smallest doc_id goes on. Bands are worked through in steps. In
each bucket of equal bands the most central member (the one with the most bucket mates over all bands) is compared with those that are
not linked with it yet, over one or two links; what is linked is then known before the next step, so a large group of near copies
costs a few comparisons a member. Pairs of open buckets that are left are found by rare shingles and bounds (`what_is_left`), so no link is lost and members of
a large bucket are not all paired. What can still cost the square of a bucket are documents of different components that have hardly
any rare shingle and yet are not linked.

Comparisons are made on full sets of shingles, streamed: the rows of a pivot's members follow its own, dealt to several tasks where
they are many. Components come from alternating stars over the verified links.

Cases: texts that are null, empty or without words have empty sets and are linked with nothing; fewer than five words are one shingle;
rows that share a doc_id count as one document, and where their texts differ links are confirmed on the smallest text; a row with
a null doc_id has a null component and is kept; doc_id is a whole number; an empty table gives an empty result; other columns are not
read; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm import words
from loomtext.llm.common import WORD, Table, in_small_batches, release, settled, small, sub_batches, with_row
from loomtext.llm.components import components

WIDTH = 5
#: Least similarity, in hundredths.
LEAST = 75
ROWS, BANDS = 5, 46
COORDINATES = ROWS * BANDS
BATCH_BYTES = 1 << 20
#: Bands of each step with pivots.
STEPS = ((0, 4), (4, BANDS))
#: Buckets of up to so many members are paired; in larger ones shingles of up to RARE documents lead to pairs.
SMALL, RARE = 8, 64
#: Members that one task compares with a pivot, and ids that are broadcast (8 bytes each).
TOGETHER, IDS_BROADCAST = 64, 1_000_000

_U = np.uint64
_rng = np.random.default_rng(75)
BYTES = _rng.integers(1, 2**63, 256, np.uint64)
MIXERS = _rng.integers(1, 2**63, WIDTH + 1, np.uint64) | _U(1)
SEEDS = _rng.integers(1, 2**63, 2 * COORDINATES, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit numbers of each word, from the BLAKE2 digest of its bytes. Each distinct word is digested once."""
    first, number = words.distinct(data, starts, ends, words.names(BYTES[data], starts, ends))
    buffer, digest = data.tobytes(), hashlib.blake2b
    found = b"".join([digest(buffer[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
    return np.ascontiguousarray(np.frombuffer(found, np.uint64).reshape(-1, 2)[number].T)


def shingle_hashes(texts: list[bytes], prints: bool = False) -> list:
    """The sorted distinct hashes of each lower-cased text's shingles; with prints, pairs of them and of a digest of the set.

    The digest is taken over a second, independent hash of each shingle too, so that equal digests stand for equal sets.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    found = word_digests(data, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    firsts = np.searchsorted(starts, np.concatenate([[0], bounds]))
    every = np.zeros((2, max(len(starts) - WIDTH + 1, 0)), np.uint64)
    for k in range(WIDTH if every.size else 0):
        every += found[:, k : k + every.shape[1]] * MIXERS[k]
    every = mixed(every)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= WIDTH:
            mine = every[:, a : b - WIDTH + 1]
        elif b > a:
            mine = mixed((found[:, a:b] * MIXERS[: b - a]).sum(axis=1, keepdims=True, dtype=np.uint64) + MIXERS[WIDTH] * _U(b - a))
        else:
            mine = np.zeros((2, 0), np.uint64)
        hashes, place = np.unique(mine[0], return_index=True)
        out.append((hashes, hashlib.blake2b(hashes.tobytes() + mine[1][place].tobytes(), digest_size=16).digest()) if prints else hashes)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set: round number and value, the least in each bin."""
    full = _U(2**64 - 1)
    bins = np.full(COORDINATES, full, np.uint64)
    done, step = 0, max(1, -(-4 * COORDINATES // len(hashes)))
    while done < COORDINATES and (bins == full).any():
        seeds = SEEDS[done : min(COORDINATES, done + step)]
        x = mixed(hashes[None, :] + seeds[:, None])
        place = ((x >> _U(32)) * _U(COORDINATES)) >> _U(32)
        value = (np.arange(done, done + len(seeds), dtype=np.uint64)[:, None] << _U(32)) | (x & _U(0xFFFFFFFF))
        np.minimum.at(bins, place.ravel().astype(np.int64), value.ravel())
        done, step = done + len(seeds), 2 * step
    for j in np.flatnonzero(bins == full):
        bins[j] = (_U(COORDINATES + j) << _U(32)) | (mixed(hashes + SEEDS[COORDINATES + j]) & _U(0xFFFFFFFF)).min()
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in bins.reshape(BANDS, ROWS).T:
        key = mixed(key * words.BASE + column)
    return key.view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (a, b) and band keys of each row."""

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                sets, digests = zip(*shingle_hashes([(t or "").encode().lower() for t in batch.column("text").to_pylist()], prints=True))
                prints = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                known: dict = {}  # copies in a batch are sketched once
                keys = []
                for s, p in zip(sets, prints.tolist(), strict=True):
                    if len(s) and tuple(p) not in known:
                        known[tuple(p)] = band_keys(sketch(s))
                    keys.append(known[tuple(p)] if len(s) else None)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_shingles", "a", "b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, bands array<long>")


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < WIDTH:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(WIDTH))))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (pivot, member) whose full sets are similar enough. A pivot with many members is dealt to several tasks."""
    hot = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts")).filter("salts > 1")
    hot = F.broadcast(hot) if small(hot, IDS_BROADCAST) else hot
    dealt = pairs.join(hot, "pivot", "left").select("pivot", "member", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    heads = dealt.select("pivot", "salt", F.col("pivot").alias("doc"), F.lit(0).alias("role")).distinct()
    rows = heads.union(dealt.select("pivot", "salt", F.col("member").alias("doc"), F.lit(1).alias("role")))
    rows = rows.join(texts, F.col("doc") == F.col("text_id")).select("pivot", "salt", "role", "doc", "text")

    def run(batches):
        at, held = None, frozenset()
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                found = []
                for pivot, salt, role, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                    mine = shingle_set(text)
                    if role == 0:
                        at, held = (pivot, salt), mine
                    elif at == (pivot, salt):
                        common = len(held & mine)
                        if 100 * common >= LEAST * (len(held) + len(mine) - common):
                            found.append((pivot, doc))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role").mapInArrow(run, "u long, v long")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(token, doc): the hashes of each text's distinct shingles."""

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                sets = shingle_hashes([(t or "").encode().lower() for t in batch.column("text").to_pylist()])
                docs = np.repeat(batch.column("text_id").to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(docs)], names=["token", "doc"])

    return texts.mapInArrow(run, "token long, doc long")


def labelled(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """members with the component `at` that each document is in so far."""
    if known is None:
        return members.withColumn("at", F.col("doc"))
    return members.join(known, F.col("doc") == F.col("node"), "left").withColumn("at", F.coalesce("component", "doc")).drop("node", "component")


def as_pairs(pivot, member) -> list:
    return [F.least(pivot, member).alias("pivot"), F.greatest(pivot, member).alias("member")]


def with_pivots(here: DataFrame) -> DataFrame:
    """Pairs of each open bucket's most central member with those in other components."""
    central = F.struct("weight", -F.col("doc"))
    spread = here.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max_by("doc", central).alias("pivot"), F.max_by("at", central).alias("main"))
    spread = spread.filter("low < high").select("key", "pivot", "main")
    return here.join(spread, "key").filter("at <> main").select(*as_pairs("pivot", "doc")).distinct()


def apart(left: DataFrame, on: str, *conditions) -> DataFrame:
    """Pairs of rows (on, doc, at, size) that agree in `on`, lie in different components and may be similar by their sizes."""
    right = left.select(*[F.col(c).alias(f"{c}_2") for c in left.columns])
    fits = (100 * F.least("size", "size_2") >= LEAST * F.greatest("size", "size_2")) & (F.col("at") < F.col("at_2"))
    for c in conditions:
        fits &= c
    return left.join(right, (F.col(on) == F.col(f"{on}_2")) & fits).select(*as_pairs("doc", "doc_2")).distinct()


def open_buckets(here: DataFrame) -> DataFrame:
    """The rows of buckets whose members lie in several components."""
    spread = here.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high").select("key")
    return here.join(spread, "key", "left_semi")


def what_is_left(here: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of open buckets that could still be similar, found without pairing all members of a large bucket.

    Small buckets have few pairs. In large ones a shingle is rare if at most RARE of their documents hold it. A pair that shares a rare
    shingle is found by that shingle. A pair that shares none has at most so many common shingles as either has that are not rare; that
    bounds the size of a partner, and a member whose bound is under the least size in a bucket leaves it.
    """
    here = settled(open_buckets(here))
    pairs = apart(here.filter(F.col("n") <= SMALL).select("key", "doc", "at", "size"), "key")
    large = here.filter(F.col("n") > SMALL)
    if large.isEmpty():
        return pairs
    docs = settled(large.select("doc", "at", "size").distinct())
    tokens = shingle_rows(texts.join(docs.select(F.col("doc").alias("text_id")), "text_id", "left_semi"))
    rare = settled(tokens.withColumn("n", F.count("*").over(W.partitionBy("token"))).filter(F.col("n") <= RARE))
    # Shingles of one passage or edit have the same documents: each set of documents, RARE at most, is looked at once.
    held = rare.filter("n > 1").join(docs, "doc").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc", "at", "size"))).alias("held"))
    fits = lambda x, y: (x["at"] < y["at"]) & (100 * F.least(x["size"], y["size"]) >= LEAST * F.greatest(x["size"], y["size"]))
    pair = lambda x, y: F.struct(*as_pairs(x["doc"], y["doc"]))
    both = F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: fits(x, y)), lambda y: pair(x, y))))
    sharing = held.select("held").distinct().select(F.explode(both).alias("pair")).select("pair.*").distinct()
    # 100 * common >= LEAST * (size + partner - common), and no more common than what is not rare.
    common = F.col("size") - F.coalesce("rare", F.lit(0))
    most = F.floor(common * (100 + LEAST) / LEAST) - F.col("size")
    bounds = docs.join(rare.groupBy("doc").agg(F.count("*").alias("rare")), "doc", "left").select("doc", most.alias("most"))
    bounded = large.join(bounds, "doc")
    least = bounded.groupBy("key").agg(F.min("size").alias("least"))
    bounded = open_buckets(bounded.join(least, "key").filter("most >= least").select("key", "doc", "at", "size", "most"))
    return pairs.union(sharing).union(apart(bounded, "key", F.col("size_2") <= F.col("most"), F.col("size") <= F.col("most_2"))).distinct()


def joined_so_far(edges: DataFrame) -> DataFrame:
    """node and the least of what two steps along the links reach: equal ones are in one component, which is enough to pass pairs over."""
    both = edges.union(edges.select("v", "u"))
    near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    return settled(both.join(near, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("component")).withColumnRenamed("u", "node"))


def links(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node and component of the documents that share buckets (key, doc, band, n, size, weight); None if no two are linked."""
    edges, tried, known = None, None, None
    for first, last in (*STEPS, (0, BANDS)):
        here = labelled(members.filter(F.col("band").between(first, last - 1)), known)
        pairs = with_pivots(here) if (first, last) in STEPS else what_is_left(here, texts)
        pairs = settled(pairs if tried is None else pairs.join(tried, ["pivot", "member"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = settled(verified(pairs, texts))
        tried = pairs if tried is None else tried.union(pairs)
        if not more.isEmpty():
            edges = more if edges is None else edges.union(more)
            known = joined_so_far(edges) if (first, last) in STEPS else None
        del here, pairs, more
        release(members.sparkSession)
    return None if edges is None else components(edges)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    table = Table(described(in_small_batches(docs)))
    try:
        rows = table.read()
        full = rows.filter("n_shingles > 0 and doc_id is not null")
        classes = settled(full.groupBy("a", "b").agg(F.min("doc_id").alias("rep")))
        heads = full.join(classes, ["a", "b"]).filter("doc_id = rep")
        keys = heads.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        members = settled(keys.join(shared, "key").distinct())
        central = members.groupBy("doc").agg(F.sum("n").alias("weight"))
        members = settled(members.join(central, "doc"))
        texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), "text")
        needed = central.select(F.col("doc").alias("text_id"))
        needed = F.broadcast(needed) if small(needed, IDS_BROADCAST) else needed
        texts = Table(texts.join(needed, "text_id", "left_semi").groupBy("text_id").agg(F.min("text").alias("text")))
        try:
            found = links(members, texts.read())
        finally:
            texts.drop()
        if found is not None:
            classes = classes.join(found, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
        else:
            classes = classes.withColumnRenamed("rep", "component_id")
        own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        out = rows.select("doc_id", "n_shingles", "a", "b").join(classes, ["a", "b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
        return settled(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    finally:
        table.drop()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns; rows with a null doc_id stay. Texts are shuffled only if very many go."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = F.broadcast(gone) if small(gone, IDS_BROADCAST) else gone
    return with_row(docs, "doc_id").join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select("row.*")


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for op6_minhash_dedup: all pairs that share a shingle, and components by reach."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{WORD}') ws from documents),
sets as (
  select distinct doc_id, array_to_string(ws[i:i + {WIDTH - 1}], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) i from w where len(ws) > 0)),
sizes as (select doc_id, count(*) n from sets group by 1),
common as (select a.doc_id u, b.doc_id v, count(*) n from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select u, v from common join sizes a on u = a.doc_id join sizes b on v = b.doc_id where 100 * common.n >= {LEAST} * (a.n + b.n - common.n)),
edges as (select u, v from links union all select v, u from links),
reach as (select doc_id, doc_id r from w union select reach.doc_id, edges.v from reach join edges on reach.r = edges.u),
least as (select doc_id, min(r) component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from w join least using (doc_id) left join sizes using (doc_id)"""
