"""Alignment of two tokenizers' tokens by a sweep over the places at which they end.

Tokenizer A is byte-level BPE over a space and the text, B are pieces over the text, to which the library adds the space. Each of them
yields end events: (document, offset, side, ids), BLOCK tokens in a row, since a token's end follows from the row's offset and the tokens'
lengths. The events of both sides are united, dealt out by document and sorted by offset; a machine reads them once. Its state is the two
running offsets and the tokens since the last place where both sides ended; each common end closes a group. In a group every A token is
linked with every B token.

How many documents hold a linked pair of ids is summed from the distinct pairs of each document, pre-aggregated in each task. What is
looked up for a document's links are the pairs of the whole corpus with the highest counts, PAIRS_BROADCAST at most, and the highest
count of each A id, of which there are no more than ids. Rarer pairs are joined by pair; each is in few documents, so no key is hot.

Cases: null and empty texts, and texts whose joined tokens of either side differ from a space and the text (a text with U+2581, say),
have no tokens: zeros and an empty digest. Special tokens' strings in texts are plain text. Rows that share a doc_id are aligned each;
equal rows among them are swept once and counted as often as they come. A null doc_id is a document. Texts of any length are encoded
whole. Links whose counts tie are all best. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import token_binary, words
from loomtext.llm.bpe import Offsets, tokenizer_file
from loomtext.llm.common import Table, in_small_batches, settled, sub_batches

A, B = 0, 1
SPACE = "\u2581"
#: Words of each side that a worker remembers.
WORDS_HELD = 250_000
BATCH_BYTES = 1 << 20
#: Tokens of one row of events.
BLOCK = 1 << 14
#: A pair of ids is a number: the A id, then SHIFT bits for the B id.
SHIFT = 15
#: Groups with more links are counted by their distinct ids.
WIDE = 1 << 12
PAIRS_BROADCAST = 1 << 20
#: Pairs that a task gathers before it adds them up, and sums that it holds before it hands them on.
GATHERED, SUMS = 1 << 22, 1 << 21
NO_TOKENS = -1
DECIMAL = Offsets([b",%d" % i for i in range(1 << 16)])


class ByteLevel(token_binary.LibraryEncoder):
    """Side A: a space and the text, without special tokens. Distinct words are looked up, and encoded by the library once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        super().__init__(path)
        self.cut, self.tokenizer.encode_special_tokens = None, True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = self.decoded

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [x.astype(np.uint16) for x in self.encode_all([" " + t for t in texts])]
        self.memory.trim(WORDS_HELD)
        return found


class Pieces:
    """Side B: the text; the library adds the space.

    Where no piece has a space behind another character, no merge crosses the start of a run of spaces, so words (such a run and what
    follows it) are encoded by themselves, each distinct one once. Other vocabularies get whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size())]
        self.bytes = Offsets([bytes([int(p[1:-1], 16)]) if tool.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.values = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64)
        self.fresh()

    def fresh(self) -> None:
        self.memory = {"": np.array([self.tokenizer.piece_to_id(SPACE)], np.uint16).tobytes()}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(ids, np.uint16) for ids in self.tokenizer.encode(texts, num_threads=1)]
        raw = [(" " + t).encode() for t in texts]
        buffer, stops = b"".join(raw), np.cumsum([len(r) for r in raw])
        data = np.frombuffer(buffer, np.uint8)
        start = data == 32
        start[1:] &= ~start[:-1]
        start[stops - [len(r) for r in raw]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        first, number = words.distinct(data, starts, ends, words.names(self.values[data], starts, ends))
        table = Offsets(self.looked_up([buffer[a + 1 : b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]), np.uint16)
        ids = table.take(number)
        sizes = np.concatenate([[0], np.cumsum(table.size[number])])
        return np.split(ids, sizes[np.searchsorted(starts, stops[:-1])])

    def looked_up(self, some: list[str]) -> list[bytes]:
        """The ids of words without their first space, which the library adds."""
        if len(self.memory) > WORDS_HELD:
            self.fresh()
        memory = self.memory
        got = list(map(memory.get, some))
        unseen = [k for k, x in enumerate(got) if x is None]
        closed, alone = [], []
        for k in unseen:
            (alone if some[k][-1] == " " else closed).append(some[k])
        parts = [closed[k : k + token_binary.TOGETHER] for k in range(0, len(closed), token_binary.TOGETHER)]
        for part, found in zip(parts, self.tokenizer.encode([" ".join(p) for p in parts], num_threads=1) if parts else (), strict=True):
            ids = np.array(found, np.uint16)
            cuts = words.token_cuts(self.bytes.size[ids], [" " + w for w in part], 2)
            if cuts is None:  # a text of which a piece stands for other bytes
                alone += part
                continue
            raw = ids.tobytes()
            memory.update(zip(part, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
        for w, ids in zip(alone, self.tokenizer.encode(alone, num_threads=1) if alone else (), strict=True):
            memory[w] = array("H", ids).tobytes()
        for k in unseen:
            got[k] = memory[some[k]]
        return got


SIDES = ((ByteLevel, "byte_bpe_50k.json"), (Pieces, "piece_bpe_32k.model"))
_held: dict = {}


def tool(side: int, path: str | None = None):
    """One tokenizer per side, file and worker."""
    kind, name = SIDES[side]
    if (side, path) not in _held:
        _held[side, path] = found = kind(path or tokenizer_file(name))
        if len(found.bytes.size) > (1 << 16 if side == A else 1 << SHIFT):
            raise ValueError(f"side {side} has {len(found.bytes.size)} ids; {1 << 16} and {1 << SHIFT} are the most")
    return _held[side, path]


def end_events(docs: DataFrame, side: int, path: str | None = None) -> DataFrame:
    """doc_id, digest of the text, offset, side and ids (16 bit each) of one side; offset NO_TOKENS says that the document has none."""
    rows = in_small_batches(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")

    def run(batches):
        mine = tool(side, path)
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                owners, offsets, blocks = [], [], []
                for k, (text, ids) in enumerate(zip(texts, mine.encode(texts), strict=True)):
                    if not text or mine.bytes.gather(ids) != b" " + text.encode():
                        owners.append(k)
                        offsets.append(NO_TOKENS)
                        blocks.append(b"")
                        continue
                    before = np.concatenate([[0], np.cumsum(mine.bytes.size[ids])])
                    for start in range(0, len(ids), BLOCK):
                        owners.append(k)
                        offsets.append(int(before[start]))
                        blocks.append(ids[start : start + BLOCK].tobytes())
                at = pa.array(owners, pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(offsets, pa.int64()), pa.array([side] * len(owners), pa.int8()), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "offset", "side", "ids"])

    kind = rows.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("digest", "binary").add("offset", "long").add("side", "byte").add("ids", "binary")
    return rows.mapInArrow(run, schema)


class Sweep:
    """The machine of one document: tokens of either side since the last common end."""

    def __init__(self, sizes):
        self.sizes, self.copies, self.void = sizes, 0, False
        self.at, self.start = [0, 0], 0
        self.ids = [[np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]]
        self.ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        self.held = 0

    def add(self, offset: int, side: int, block: bytes) -> None:
        """The next block of a side; blocks of copies come again and are passed over."""
        self.copies += side == A and offset <= 0
        self.void |= offset == NO_TOKENS
        if self.void or offset != self.at[side] or not block:
            return
        ids = np.frombuffer(block, np.uint16)
        ends = offset + np.cumsum(self.sizes[side][ids])
        self.ids[side].append(ids)
        self.ends[side].append(ends)
        self.at[side] = int(ends[-1])
        self.held += len(ids)

    def closed(self):
        """The groups that are complete: A ids, B ids, how many of each a group has, and where groups end; None if there are none."""
        (a, b), (ends_a, ends_b) = ([np.concatenate(x) for x in parts] for parts in (self.ids, self.ends))
        place = np.searchsorted(ends_b, ends_a)
        hit = np.append(ends_b, -1)[place] == ends_a
        stop_a, stop_b = np.flatnonzero(hit) + 1, place[hit] + 1
        last_a, last_b = (int(x[-1]) if len(x) else 0 for x in (stop_a, stop_b))
        self.ids, self.ends = [[a[last_a:]], [b[last_b:]]], [[ends_a[last_a:]], [ends_b[last_b:]]]
        self.held = len(a) - last_a + len(b) - last_b
        return (a[:last_a], b[:last_b], np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), ends_a[hit]) if last_a else None


def swept(events: DataFrame, sink, schema: T.StructType, paths=(None, None)) -> DataFrame:
    """What a sink makes of the groups of each document. Events are dealt out by document and sorted by offset."""
    together = events.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "offset", "side")

    def run(batches):
        sizes = [tool(side, paths[side]).bytes.size for side in (A, B)]
        out, at, sweep = sink(schema), None, None

        def groups():
            found = sweep.closed()
            if found:
                out.add(*found)

        for batch in batches:
            blocks = batch.column("ids")
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if sweep is None or at != row[:2]:
                    if sweep is not None:
                        groups()
                        out.close(*at, sweep)
                        if out.full():
                            yield out.take()
                    at, sweep = row[:2], Sweep(sizes)
                sweep.add(row[2], row[3], blocks[k].as_py())
                if sweep.held > 4 * BLOCK:
                    groups()
        if sweep is not None:
            groups()
            out.close(*at, sweep)
        yield out.take()

    return together.mapInArrow(run, schema)


def in_order(a, b, n_a, n_b):
    """Places of the A and the B tokens if each group's A tokens come before its B tokens, and where groups and their B tokens start."""
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a = np.arange(len(a)) + np.repeat(before_b, n_a)
    at_b = np.arange(len(b)) + np.repeat(before_a + n_a, n_b)
    return at_a, at_b, at_a[before_a], at_b[before_b]


def group_text(a, b, n_a, n_b) -> bytes:
    """;a1,a2|b1;a3|b2,b3 for all groups."""
    at_a, at_b, starts, middles = in_order(a, b, n_a, n_b)
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b], marks[starts], marks[middles] = a, b, ord(";"), ord("|")
    text = np.frombuffer(DECIMAL.gather(ids), np.uint8).copy()
    sizes = DECIMAL.size[ids]
    text[np.cumsum(sizes) - sizes] = marks
    return text.tobytes()


def links(a, b, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids that groups link, each once, and how many links each has."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    partners = np.repeat(np.where(wide, 0, n_b), n_a)  # of each A token
    first = np.repeat(before_b, n_a)
    of = np.arange(int(partners.sum())) - np.repeat(np.cumsum(partners) - partners - first, partners)
    pairs, times = np.unique(np.repeat(a, partners) << SHIFT | b[of], return_counts=True)
    if not wide.any():
        return pairs, times
    parts = [(pairs, times)]
    for g in np.flatnonzero(wide):
        ids_a, many_a = np.unique(a[before_a[g] : before_a[g] + n_a[g]], return_counts=True)
        ids_b, many_b = np.unique(b[before_b[g] : before_b[g] + n_b[g]], return_counts=True)
        parts.append(((ids_a[:, None] << SHIFT | ids_b).ravel(), (many_a[:, None] * many_b).ravel()))
    return added(parts)


def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of several lists of (pairs, numbers), and the sums of their numbers."""
    pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return pairs, sums


class Digests:
    """A row per document: counts, digest of the groups, distinct pairs and their links. It holds the pairs of one document."""

    def __init__(self, schema):
        self.names, self.rows, self.pairs, self.times, self.many = schema.names, [], [], [], 0
        self.fresh()

    def fresh(self):
        self.hash, self.counts, self.parts, self.held, self.merged = hashlib.sha256(), np.zeros(4, np.int64), [], 0, 0

    def add(self, a, b, n_a, n_b, _):
        self.hash.update(group_text(a, b, n_a, n_b)[0 if self.counts[2] else 1 :])
        self.counts += [len(a), len(b), len(n_a), int((n_a * n_b).sum())]
        self.parts.append(links(a, b, n_a, n_b))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.merged + GATHERED:
            self.parts = [added(self.parts)]
            self.held = self.merged = len(self.parts[0][0])

    def close(self, doc_id, digest, sweep):
        pairs, times = added(self.parts) if len(self.parts) > 1 else self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 2
        for copy in range(sweep.copies):
            self.rows.append((doc_id, digest, copy, *self.counts.tolist(), self.hash.hexdigest() if self.counts[2] else ""))
            self.pairs.append(pairs)
            self.times.append(times)
            self.many += len(pairs)
        self.fresh()

    def full(self):
        return self.many > GATHERED // 4 or len(self.rows) > 10_000

    def take(self):
        return self._batch(*self.emptied())

    def emptied(self):
        out = self.rows, self.pairs, self.times
        self.rows, self.pairs, self.times, self.many = [], [], [], 0
        return out

    def _batch(self, rows, pairs, times):
        kinds = [None, pa.binary(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        starts = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs], dtype=np.int64)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32))) for x in (pairs, times)]
        return pa.RecordBatch.from_arrays([*columns, *lists], names=self.names)


class Groups:
    """A row per group: document, bytes at which it starts and ends, A ids and B ids."""

    def __init__(self, schema):
        self.names, self.rows, self.mine, self.at = schema.names, [], [], 0

    def add(self, a, b, n_a, n_b, ends):
        stops_a, stops_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
        starts = [self.at, *ends.tolist()]
        a, b, k, m = a.tolist(), b.tolist(), 0, 0
        for start, end, i, j in zip(starts, ends.tolist(), stops_a, stops_b):
            self.mine.append((start, end, a[k:i], b[m:j]))
            k, m = i, j
        self.at = int(ends[-1])

    def close(self, doc_id, digest, sweep):
        self.rows.extend((doc_id, copy, *r) for copy in range(sweep.copies) for r in self.mine)
        self.mine, self.at = [], 0

    def full(self):
        return len(self.rows) > 10_000

    def take(self):
        rows, self.rows = self.rows, []
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=self.names)


def both_sides(docs: DataFrame, paths=(None, None)) -> DataFrame:
    return end_events(docs, A, paths[A]).union(end_events(docs, B, paths[B]))


def groups(docs: DataFrame, paths=(None, None)) -> DataFrame:
    """doc_id, copy (of rows that are equal), start, stop, a_ids and b_ids of each group; offsets count the bytes of a space and the text."""
    kind = docs.schema["doc_id"].dataType
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("doc_id", kind).add("copy", "integer").add("start", "long").add("stop", "long").add("a_ids", ids).add("b_ids", ids)
    return swept(both_sides(docs, paths), _typed(Groups, kind), schema, paths)


def aligned(docs: DataFrame, paths=(None, None)) -> DataFrame:
    """doc_id, digest, copy, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (links per pair) of each row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("digest", "binary").add("copy", "integer")
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    ints = T.ArrayType(T.IntegerType())
    return swept(both_sides(docs, paths), _typed(Digests, kind), schema.add("groups_sha256", "string").add("pairs", ints).add("times", ints), paths)


def _typed(sink, kind):
    """A sink whose first column has the type of doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    first = to_arrow_type(kind)

    class Typed(sink):
        def take(self):
            batch = super().take()
            return pa.RecordBatch.from_arrays([batch.column(0).cast(first), *batch.columns[1:]], names=batch.schema.names)

    return Typed


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n, how many rows hold it in their pairs. Each task adds up what it reads before it hands it on."""

    def run(batches):
        gathered, many, sums, held = [], 0, [], 0

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1])], names=["pair", "n"])

        def add_up():
            return np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.int64),) * 2

        for batch in batches:
            gathered.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            many += len(gathered[-1])
            if many > GATHERED:
                sums = [added([*sums, add_up()])]
                gathered, many, held = [], 0, len(sums[0][0])
                if held > SUMS:
                    yield batch_of(sums[0])
                    sums = []
        yield batch_of(added([*sums, add_up()]))

    return rows.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


KEY = ("doc_id", "digest", "copy")


def scored(rows: DataFrame, bound: int = PAIRS_BROADCAST) -> DataFrame:
    """rows of `aligned`, each with n_best and count_sum instead of its pairs. rows is read twice and should be a table."""
    spark = rows.sparkSession
    counts = settled(pair_counts(rows))
    power = F.floor(F.log2("n")).cast("int")
    above, least = 0, 2
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # one row per power of two
        if r.power and above + r["count"] > bound:
            least = 2 ** (r.power + 1)
            break
        above += r["count"] if r.power else 0
    # Rows of counts number as many as least says, and those of best as many as A has ids.
    a_id = F.shiftright("pair", SHIFT)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("best"))
    frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("pair")
    highest = best.toPandas()
    table = np.zeros(1 << 16, np.int64)
    table[highest["a"].to_numpy()] = highest["best"].to_numpy()
    known = spark.sparkContext.broadcast((frequent["pair"].to_numpy(np.int32), frequent["n"].to_numpy(np.int64), table))
    whole = least == 2  # all pairs that are not known are in one row

    def run(batches):
        pairs_known, n_known, highest = known.value
        pairs_known, n_known = np.append(pairs_known, np.int32(-1)), np.append(n_known, 0)
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            times = times.astype(np.int64)
            place = np.searchsorted(pairs_known[:-1], pairs)
            hit = pairs_known[place] == pairs
            n = np.where(hit, n_known[place], int(whole))
            sums = [_by_row(x, sizes) for x in (times * (n == highest[pairs >> SHIFT]) * (hit | whole), times * n)]
            rest = np.zeros(len(pairs), bool) if whole else ~hit
            starts = pa.array(np.concatenate([[0], np.cumsum(_by_row(rest.astype(np.int64), sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x[rest].astype(np.int32))) for x in (pairs, times)]
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *lists], names=[*carried, "n_best", "count_sum", "pairs", "times"])

    carried = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = T.StructType([rows.schema[c] for c in carried]).add("n_best", "long").add("count_sum", "long").add(rows.schema["pairs"]).add(rows.schema["times"])
    out = rows.select(*carried, "pairs", "times").mapInArrow(run, schema)
    if whole:
        return out.drop("pairs", "times")
    rarer = counts.filter(F.col("n") < least).select("pair", "n", a_id.alias("a")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    each = out.select(*KEY, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(*KEY, F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    more = each.join(rarer, "pair").groupBy(*KEY).agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = more.select(*[F.col(c).alias(f"of_{c}") for c in KEY], "more_best", "more_sum")
    same = F.lit(True)
    for c in KEY:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    whole_sum = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.join(more, same, "left").select(*carried, whole_sum("n_best", "more_best"), whole_sum("count_sum", "more_sum"))


def _by_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, of which there are `sizes`."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    table = Table(aligned(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    try:
        return settled(scored(table.read()).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    finally:
        table.drop()
