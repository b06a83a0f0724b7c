"""Removal of repeated byte strings across documents, by suffix arrays over neighbourhoods of shared anchors.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Documents are compared in steps that
keep all that could match and drop the rest early:

1.  Copies: of equal texts only the one with the smallest doc_id goes on; the others go as a whole.
2.  Anchors: of the GRAM-byte strings inside each 50-byte window, those with the least hash. Equal windows have equal anchors, and about
    one byte in seventeen starts one. Only anchors that occur in two documents matter.
3.  Neighbourhoods: the bytes around a shared anchor that windows over it can reach. Of equal ones the smallest document keeps its
    own; the others lose it as a whole. Those that meet in one batch are settled there, so a very common passage sends one row a batch.
4.  Different neighbourhoods of the same anchors are laid end to end and their suffixes sorted in two stages: suffixes smaller than
    their successors are sorted directly, all others are induced by scans over buckets of first bytes. Neighbours in that order that
    share a prefix of 50 bytes form runs; a window goes if its run holds a smaller document.
5.  An anchor with more than MANY different neighbourhoods does not go to one task: they are dealt out by what its windows with more to the
    left have in common, and by what those with more to the right do. Where such a part is still too large its windows are halved again, down
    to single windows, whose smallest document comes from a pre-aggregated minimum.

Documents lie in a table bucketed by doc_id, so that the two passes that need their texts again do not shuffle them.

Cases: null and empty texts have no bytes; texts under 50 bytes keep theirs; equal rows with one doc_id keep theirs, since neither has
the smaller id; a row with a null doc_id is left as it is and removes nothing; an empty table gives an empty result; other columns are
not read. Cut texts can end inside a character; `deduplicated` replaces such bytes with U+FFFD.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import Table, finish, in_small_batches, owning, settled, small, sub_batches, with_row

LENGTH, GRAM = 50, 16
LEFT = LENGTH - GRAM
HALF = LEFT // 2
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
#: Files that a bucketed table may get; beyond it texts are dealt to their buckets first.
MOST_FILES = 20_000
IDS_BROADCAST = 1_000_000
#: Neighbourhoods whose suffixes are sorted together at least, and most of one anchor: at some 6 KB each that is 50 MB of memory.
TOGETHER, MANY = 8_192, 8_192
ALL = (1 << (LEFT + 1)) - 1

_U = np.uint64
_rng = np.random.default_rng(50)
BYTES = _rng.integers(1, 2**63, 256, np.uint64)
BASE, INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolled:
    """Hashes of any substring of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        if len(_powers[0]) < size:
            for k, b in enumerate((BASE, INVERSE)):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                _powers[k] = np.multiply.accumulate(row)
        self.down = _powers[1]
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(BYTES[data] * _powers[0][: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.down[starts]

    def every(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width] at each i that has so many."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def anchors(texts: list[bytes]):
    """(row, place in the buffer, hash, hash of the neighbourhood, its start, its end) of all anchors, and the buffer."""
    buffer = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(buffer, np.uint8)
    if len(data) < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty, buffer
    rolled = Rolled(data)
    grams = _mixed(rolled.every(GRAM))
    least = _slid(grams, LEFT + 1, np.minimum)  # of each window
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0  # windows over a text's end
    padded = np.zeros(len(grams) + LEFT, np.uint64)
    padded[LEFT : LEFT + len(least)] = least
    place = np.flatnonzero(_slid(padded, LEFT + 1, np.maximum) == grams)
    row = owner[place]
    start = np.maximum(place - LEFT, ends[row] - np.diff(ends, prepend=0)[row])
    stop = np.minimum(place + LENGTH, ends[row])
    around = _mixed(rolled.of(start, stop) + (place - start).astype(np.uint64) * BASE + (stop - place).astype(np.uint64))
    # Names of 56 and 63 bits: both name a neighbourhood.
    return row, place, (grams[place] >> _U(8)).view(np.int64), (around >> _U(1)).view(np.int64), start, stop, buffer


def window_order(texts: np.ndarray, ends: np.ndarray):
    """Start places, in the order of their suffixes, of all 50-byte windows of strings that lie end to end in `texts`.

    Suffixes end with their string; equal windows come next to each other.
    """
    # Symbols: 0 ends a string, bytes follow.
    count = len(ends)
    shift = np.zeros(len(texts) + count, bool)
    stops = ends + np.arange(count)
    shift[stops] = True
    symbols = np.zeros(len(shift), np.int16)
    symbols[~shift] = texts.astype(np.int16) + 1
    # Whether a suffix is smaller than its successor; in a run of one byte its last one decides.
    nxt = np.append(symbols[1:], 0).astype(np.int16)
    nxt[stops] = 0
    differs = np.flatnonzero((symbols != nxt) | shift)
    decides = differs[np.searchsorted(differs, np.arange(len(symbols)))]
    small_ = (symbols[decides] < nxt[decides]) & ~shift[decides]
    # Windows, and beyond a string's last window all up to the next suffix that is sorted directly.
    lengths = np.diff(ends, prepend=0)
    firsts = stops - lengths
    owner = np.repeat(np.arange(count), lengths + 1)
    last = stops - LENGTH  # of the windows
    places = np.arange(len(symbols))
    window = places <= last[owner]
    direct_or_end = np.flatnonzero(small_ | shift)
    beyond = direct_or_end[np.searchsorted(direct_or_end, np.minimum(np.maximum(last + 1, firsts), stops))]
    used = places <= np.minimum(beyond, stops)[owner]
    direct = np.flatnonzero(used & small_)
    keys = packed(texts, direct - owner[direct], stops[owner[direct]] - direct)
    direct = direct[in_order(keys)]
    first = symbols[direct]
    cuts = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(258)]
    induced[0].append(np.flatnonzero(used & shift))
    order = []
    large = used & ~small_ & ~shift
    for c in range(257):
        scan = induced[c]
        wave = np.concatenate(scan) if scan else np.zeros(0, np.int64)
        scan = [wave]
        while len(wave) and c:
            wave = wave[wave > 0] - 1
            wave = wave[large[wave] & (symbols[wave] == c)]
            scan.append(wave)
        bucket = np.concatenate([*scan, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (symbols[before] > c)]
        if len(before):
            kinds = symbols[before]
            by = np.argsort(kinds, kind="stable")
            before, kinds = before[by], kinds[by]
            at = np.flatnonzero(np.diff(kinds, prepend=-1))
            for a, part in zip(kinds[at], np.split(before, at[1:]), strict=True):
                induced[a].append(part)
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    return found[window[found]], owner, firsts


#: The highest 0 to 8 bytes of a number.
HIGH = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], np.uint64)


def packed(texts: np.ndarray, places: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 50 bytes from each place as rows of big numbers, in order. Of a string that has fewer left the rest is 0, and their number, which
    is the last row, tells it from one that goes on with zeros."""
    raw = np.concatenate([texts, np.zeros(LENGTH + 8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    size, parts = np.minimum(left, LENGTH), -(-LENGTH // 8)
    rows = np.empty((parts + 1, len(places)), np.uint64)
    for j in range(parts):
        rows[j] = eight[places + 8 * j]
        rows[j] &= HIGH[np.clip(size - 8 * j, 0, 8)]
    rows[parts] = size
    return rows


def in_order(keys: np.ndarray) -> np.ndarray:
    """The order of columns by their rows, the first row first. Equal columns, of which there are many, are brought together by a hash, and
    one of each is sorted."""
    name = keys[0]
    for row in keys[1:]:
        name = _mixed(name) + row
    by = np.argsort(_mixed(name))
    there = keys[:, by]
    fresh = np.append(True, (there[:, 1:] != there[:, :-1]).any(axis=0)) if len(by) else np.zeros(0, bool)
    ranks = np.empty(np.count_nonzero(fresh), np.int64)
    ranks[np.lexsort(there[::-1, fresh])] = np.arange(len(ranks))
    return by[np.argsort(ranks[np.cumsum(fresh) - 1], kind="stable")]


def window_masks(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of each 50-byte window that is also in a string of a smaller document."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    texts = np.frombuffer(b"".join(strings), np.uint8)
    order, owner, firsts = window_order(texts, ends)
    if not len(order):
        return order, order
    keys = packed(texts, order - owner[order], np.full(len(order), LENGTH))
    # The common prefix of neighbours reaches 50 bytes where all numbers agree.
    starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    whose = owner[order]
    least = np.minimum.reduceat(docs[whose], starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    gone = least[run] < docs[whose]
    return whose[gone], (order - firsts[whose])[gone]


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def named(row: np.ndarray, h: np.ndarray, around: np.ndarray) -> np.ndarray:
    """One number for a row of a batch and a neighbourhood in it."""
    return _mixed(_mixed(row.astype(np.uint64) * BASE + h.view(np.uint64)) + around.view(np.uint64))


def listed(column: pa.Array):
    """Row numbers of a list column's entries, and its entries' fields, each a long, as arrays."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    inner = pc.list_flatten(column)
    fields = [np.asarray(inner.field(i)).astype(np.int64) for i in range(inner.type.num_fields)]
    return np.repeat(np.arange(len(sizes)), sizes), fields


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, near, doc): each document's distinct anchors with their neighbourhoods.

    near is twice the neighbourhood's name, and one more where a smaller document of the batch has the same.
    """

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                row, _, h, around, _, _, _ = anchors(texts_of(batch))
                docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                by_doc = np.argsort(np.argsort(docs, kind="stable"), kind="stable")[row]  # smaller documents first
                order = np.argsort(by_doc, kind="stable")
                h, around, docs = h[order], around[order], docs[row[order]]
                name = _mixed(h.view(np.uint64) * BASE + around.view(np.uint64))
                order = np.argsort(name, kind="stable")
                name, h, around, docs = name[order], h[order], around[order], docs[order]
                same = np.append(False, name[1:] == name[:-1])
                first = np.flatnonzero(~same)
                own = np.repeat(docs[first], np.diff(np.append(first, len(docs))))  # the smallest document with that neighbourhood
                keep = ~same
                keep[1:] |= docs[1:] != docs[:-1]
                near = around * 2 + (own < docs)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(near[keep]), pa.array(docs[keep])], names=["h", "near", "doc"])

    return docs.mapInArrow(run, "h long, near long, doc long")


def neighbourhoods(docs: DataFrame) -> DataFrame:
    """(h, around, doc, left, bytes) of the neighbourhoods (h, around) that the column `wanted` of each document lists."""

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                row, place, h, around, start, stop, buffer = anchors(texts_of(batch))
                names = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                mine, first = np.unique(named(row, h, around), return_index=True)
                rows, fields = listed(batch.column("wanted"))
                k = first[np.isin(mine, named(rows, *fields))]
                parts = [buffer[a:b] for a, b in zip(start[k].tolist(), stop[k].tolist())]
                columns = [pa.array(h[k]), pa.array(around[k]), pa.array(names[row[k]]), pa.array((place - start)[k].astype(np.int32)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "around", "doc", "left", "bytes"])

    return docs.mapInArrow(run, "h long, around long, doc long, left int, bytes binary")


def may_match(buffer: bytes, sizes: np.ndarray, left: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which neighbourhoods, laid end to end, could share a window with another one of their part.

    A window has HALF bytes or more to the left of the anchor, or else as many to its right: those and the anchor must occur twice.
    """
    rolled, ends = Rolled(np.frombuffer(buffer, np.uint8)), np.cumsum(sizes)
    at = ends - sizes + left
    found = np.zeros(len(sizes), bool)
    for begin, end in ((at - HALF, at + GRAM), (at, at + GRAM + HALF)):
        there = np.flatnonzero((begin >= ends - sizes) & (end <= ends))
        names = _mixed(_mixed(rolled.of(begin[there], end[there])) + part[there].view(np.uint64))
        _, number, times = np.unique(names, return_inverse=True, return_counts=True)
        found[there[times[number] > 1]] = True
    return found


def removals(around: DataFrame) -> DataFrame:
    """(doc, h, around, mask): what goes of each neighbourhood; bit i stands for the window that starts LEFT - i bytes before the anchor.

    Rows come sorted by the part that they belong to; strings of whole parts are gathered until there are enough to sort their suffixes together.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            part, left = table["part"].to_numpy(), table["left"].to_numpy()
            sizes = np.asarray(pc.binary_length(table["bytes"])).astype(np.int64)
            buffer = b"".join(table["bytes"].to_pylist())
            k = np.flatnonzero(may_match(buffer, sizes, left, part))
            ends = np.cumsum(sizes)
            h, near, docs = (table[c].to_numpy()[k] for c in ("h", "around", "doc"))
            whose, start = window_masks([buffer[a:b] for a, b in zip((ends - sizes)[k].tolist(), ends[k].tolist())], docs)
            masks = np.zeros(len(h), np.int64)
            np.bitwise_or.at(masks, whose, np.int64(1) << (start + LEFT - left[k][whose]))
            k = np.flatnonzero(masks)
            return pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (docs, h, near, masks)], names=["doc", "h", "around", "mask"])

        for batch in batches:
            while batch.num_rows:
                part = batch.column("part").to_numpy()
                held_rows = sum(b.num_rows for b in held)
                if held_rows >= TOGETHER and held[-1].column("part")[-1].as_py() != part[0]:
                    yield close()
                    held_rows = 0
                # As far as enough rows go, and on to the end of the last part's.
                last = part[min(max(TOGETHER - held_rows, 1), len(part)) - 1]
                stop = int(np.searchsorted(part, last, side="right"))
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
        if held:
            yield close()

    sorted_ = around.repartition("part").sortWithinPartitions("part")
    return sorted_.select("part", "h", "around", "doc", "left", "bytes").mapInArrow(run, "doc long, h long, around long, mask long")


def removals_in_parts(around: DataFrame) -> DataFrame:
    """The same as `removals` for anchors with very many neighbourhoods.

    A window that has i bytes to the left of the anchor holds all that those with low to high bytes have in common, if i is between them.
    So equal windows meet in the part that this common text names.
    """
    together = lambda masks: masks.groupBy("doc", "h", "around").agg(F.bit_or("mask").alias("mask"))
    found, ranges, rows = None, [(0, LEFT)], around
    while True:
        ranges = [r for low, high in ranges for r in ([(low, (low + high) // 2), ((low + high) // 2 + 1, high)] if low < high else [(low, high)])]
        named = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in ranges])
        inside = lambda r: (F.col("low") <= r["low"]) & (r["high"] <= F.col("high"))
        halves = named if "low" not in rows.columns else F.filter(named, inside)
        rows = rows.select("doc", "h", "around", "left", "bytes", F.explode(halves).alias("r")).select("doc", "h", "around", "left", "bytes", "r.*")
        begin, end = F.col("left") - F.col("low"), F.col("left") - F.col("high") + LENGTH
        rows = rows.filter((begin >= 0) & (end <= F.octet_length("bytes")))
        rows = rows.withColumn("part", F.xxhash64("h", "low", F.substring("bytes", begin + 1, end - begin)))
        if all(low == high for low, high in ranges):
            return together(found.union(removals_by_window(rows)))
        rows = settled(rows)
        sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
        large = settled(sizes.filter((F.col("n") > MANY) & (F.col("first") < F.col("last"))).select("part"))
        some = sizes.filter((F.col("n") <= MANY) & (F.col("first") < F.col("last"))).select("part")
        here = settled(removals(rows.join(some, "part", "left_semi")))
        found = here if found is None else found.union(here)
        if large.isEmpty():
            return together(found)
        rows = rows.join(F.broadcast(large) if small(large, IDS_BROADCAST) else large, "part", "left_semi").drop("part")


def removals_by_window(rows: DataFrame) -> DataFrame:
    """The same where a part is one window: its smallest document keeps it."""
    least = rows.groupBy("part").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("part", "least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(LEFT) - F.col("low"))
    gone = rows.join(least, "part").filter("doc > least")
    return gone.groupBy("doc", "h", "around").agg(F.bit_or(bit).alias("mask"))


def cut(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Applies the masks in the column `gone` (structs h, around, mask) to each document."""

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                whole_texts = texts_of(batch)
                rows, fields = listed(batch.column("gone"))
                touched, rows = np.unique(rows, return_inverse=True)  # the others stay as they are
                texts = [whole_texts[k] for k in touched.tolist()]
                row, place, h, around, first, last, buffer = anchors(texts)
                change = np.zeros(len(buffer) + 1, np.int64)
                if len(rows):
                    keys, masks = named(rows, fields[0], fields[1]), fields[2]
                    by = np.argsort(keys, kind="stable")
                    keys, masks = keys[by], masks[by]
                    mine = named(row, h, around)
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    masks = np.where(keys[at] == mine, masks[at], 0)
                    some = np.flatnonzero(masks)
                    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                    low, high = (ends - np.diff(ends, prepend=0))[row[some]], ends[row[some]]
                    whole, part = some[masks[some] == ALL], masks[some] != ALL
                    change += np.bincount(first[whole], minlength=len(change)) - np.bincount(last[whole], minlength=len(change))
                    some, low, high = some[part], low[part], high[part]
                    for bit in range(LEFT + 1 if len(some) else 0):
                        start = place[some] - LEFT + bit
                        start = start[(masks[some] >> bit & 1).astype(bool) & (start >= low) & (start + LENGTH <= high)]
                        np.add.at(change, start, 1)
                        np.add.at(change, start + LENGTH, -1)
                covered = np.cumsum(change[:-1]) > 0
                data, at, rows, some = np.frombuffer(buffer, np.uint8), 0, [], set(touched.tolist())
                for k, text in enumerate(whole_texts):
                    if k not in some:
                        rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), *([text.decode()] if keep_text else [])))
                        continue
                    mine = covered[at : at + len(text)]
                    spans = int(np.count_nonzero(np.diff(mine.astype(np.int8), prepend=0) == 1))
                    rest = data[at : at + len(text)][~mine].tobytes() if spans else text
                    rows.append((len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "replace")] if keep_text else [])))
                    at += len(text)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)]
                extra = [batch.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*extra, *columns], names=[*carried, *names])

    carried = [c for c in docs.columns if c not in ("text", "gone")]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
    schema = T.StructType([docs.schema[c] for c in carried])
    for name, kind in zip(names, [T.LongType()] * 3 + [T.StringType()] * 2):
        schema = schema.add(name, kind)
    return docs.select(*carried, "text", "gone").mapInArrow(run, schema)


def repeated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with keep_text also kept_text and, in `row`, all its columns."""
    spark = in_small_batches(docs).sparkSession
    others = ["row"] if keep_text else []
    docs = with_row(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *[F.col("row").dropFields("text").alias("row")] * keep_text, "text")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    marked = settled(docs.select("doc_id", size.alias("n"), F.md5(F.col("text").cast("binary")).alias("digest")).filter(F.col("n") >= LENGTH))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("least"))
    copies = settled(marked.join(first, "digest").filter("doc_id > least").select(F.col("doc_id").alias("copy"), F.col("digest").alias("of")).distinct())
    total = marked.agg(F.sum("n")).first()[0] or 0
    # As many buckets as shuffles have partitions at least, or Spark would rather shuffle the texts.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    one = F.broadcast(copies) if small(copies, IDS_BROADCAST) else copies
    same = [F.col("doc_id") == F.col("copy"), F.md5(F.col("text").cast("binary")) == F.col("of")]
    rest = docs.join(one, same, "left_anti")
    if rest.rdd.getNumPartitions() * buckets > MOST_FILES:
        rest = rest.repartition(buckets, "doc_id")
    table, marks, lasting = f"loomtext_{uuid.uuid4().hex}", None, False

    def drop():
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        if marks:
            marks.drop()

    try:
        rest.write.bucketBy(buckets, "doc_id").option("compression", "zstd").saveAsTable(table)
        held = spark.table(table)
        marks = Table(shared_anchors(held.filter("doc_id is not null").select("doc_id", "text")))
        out = cut(held.join(all_masks(held, marks.read()), F.col("doc_id") == F.col("doc"), "left").drop("doc"), keep_text)
        n = size.cast("long")
        gone = docs.join(one, same, "left_semi").select("doc_id", *others, n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *([F.lit("").alias("kept_text")] if keep_text else []))
        out, lasting = out.unionByName(gone), keep_text
        return owning(out, drop) if keep_text else settled(out)  # texts are read from the table when the result is written
    finally:
        if not lasting:
            drop()


def shared_anchors(known: DataFrame) -> DataFrame:
    """(doc, h, around, whole, many) of anchors that several documents have: whether a smaller document has the same neighbourhood, else
    what is to be compared with different ones, and whether those are many."""
    seen = anchor_rows(known)
    # Rows for which a smaller document is known need no comparison; they are dealt out, so that no anchor gathers them.
    sure, dealt = F.col("near").bitwiseAND(1) == 1, F.col("h").bitwiseXOR(F.xxhash64("doc"))
    seen = seen.select(F.when(sure, dealt).otherwise(F.col("h")).alias("h"), "near", "doc")
    seen = seen.withColumn("whole", sure | (F.col("doc") > F.min("doc").over(W.partitionBy("h", "near"))))
    of = W.partitionBy("h")
    for name, value in (("low", F.min("doc")), ("high", F.max("doc")), ("one", F.min("near")), ("other", F.max("near")), ("kinds", F.count(F.when(~F.col("whole"), 1)))):
        seen = seen.withColumn(name, value.over(of))
    # The smallest document's neighbourhood is compared with different ones of the same anchor.
    seen = seen.filter(sure | F.expr("low < high and (whole or one < other)"))
    return seen.select("doc", F.when(sure, dealt).otherwise(F.col("h")).alias("h"), F.shiftrightunsigned("near", 1).alias("around"), "whole", (F.col("kinds") > MANY).alias("many"))


def all_masks(held: DataFrame, marks: DataFrame) -> DataFrame:
    """doc and `gone`, the masks (h, around, mask) that apply to it."""
    masks = marks.filter("whole").select("doc", "h", "around", F.lit(ALL).cast("long").alias("mask"))

    def near(rows):
        wanted = rows.groupBy("doc").agg(F.collect_list(F.struct("h", "around")).alias("wanted"))
        return neighbourhoods(held.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted"))

    masks = masks.union(removals(near(marks.filter("not whole and not many")).withColumn("part", F.col("h"))))
    many = marks.filter("not whole and many")
    if not many.isEmpty():
        masks = masks.union(removals_in_parts(near(many)))
    return masks.groupBy("doc").agg(F.collect_list(F.struct("h", "around", "mask")).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated strings cut out of their texts. Rows that lose all their text go; others keep their columns.

    The result reads its tables lazily; `common.finish` drops them once it is written.
    """
    rows = repeated(docs, keep_text=True)
    out = rows.filter("n_removed = 0 or n_removed < n_bytes")
    return owning(out.select(*[F.col("kept_text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns]), lambda: finish(rows))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for op10_suffix_dedup: every window of every document, in hexadecimal digits."""
    return f"""
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) h from documents),
bytes as (select doc_id, unnest(x) c, unnest(range(0, len(x))) i from (select doc_id, regexp_extract_all(h, '..') x from d)),
windows as (
  select doc_id, i, s from (
    select doc_id, i, string_agg(c, '') over ahead s, count(*) over ahead n from bytes
    window ahead as (partition by doc_id order by i rows between current row and {LENGTH - 1} following))
  where n = {LENGTH}),
first as (select s, min(doc_id) least from windows group by 1 having count(*) > 1),
gone as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) before from windows w join first f on w.s = f.s and w.doc_id > f.least),
runs as (select doc_id, i, sum((before is null or i > before + {LENGTH})::int) over (partition by doc_id order by i) run from gone),
spans as (select doc_id, run, min(i) a, max(i) + {LENGTH} b from runs group by 1, 2),
cut as (select doc_id, list(a order by a) a, list(b order by a) b, sum(b - a) n_removed, count(*) n_spans from spans group by 1),
kept as (
  select d.doc_id, h, n_removed, n_spans,
    case when n_spans is null then h else array_to_string(list_transform(range(0, n_spans + 1), lambda k:
      substr(h, 2 * (case when k = 0 then 0 else b[k] end) + 1, 2 * ((case when k = n_spans then len(h) // 2 else a[k + 1] end) - (case when k = 0 then 0 else b[k] end)))), '') end rest
  from d left join cut using (doc_id))
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(rest)) kept_sha256 from kept"""
