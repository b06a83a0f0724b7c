"""Token ids in binary files: patched frame-of-reference blocks, in the order of doc_id.

Documents are dealt to shards by ranges of doc_id and sorted within them, so shards in order hold all ids in order. A shard is a row of
segments; a segment holds whole documents and is one binary payload:

    header   number of ids, number of blocks (two unsigned 64-bit integers)
    index    per block its start in the body (64 bit), its minimum (32 bit), its width and its number of exceptions (16 bit each)
    body     per block BLOCK differences to the minimum, their low `width` bits packed into 64-bit words, then the exceptions:
             positions (16 bit) and the high bits (32 bit) of differences that need more than `width` bits

Each block takes the width at one of PERCENTILES of its differences, whichever makes it smallest. All numbers are little-endian.

The files are a Parquet table in the shared folder, one row per segment with its documents, so that Spark's commit protocol keeps them
whole when executors are lost, and any file system that Spark reaches will do.

Ids come from the tokenizers library. A batch is cut into words at once, each distinct word is looked up, and the library encodes those
not seen before (words are told apart by their characters, not by hashes alone); texts with special tokens' strings or letters beyond the Latin ones go to it as they are. Id END follows each document.

Cases: a null text is an empty one and has only the end id; a null doc_id comes first; rows that share a doc_id follow each other in
the order of their texts' hashes; an empty table gives an empty result; other columns are not read. doc_id is a whole number. Texts of any length are encoded whole; a
document is never split over segments, so a very long one makes a long segment.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import bpe, words
from loomtext.llm.common import Table, in_small_batches, settled, sub_batches

BLOCK = 256
PERCENTILES = (75, 90, 95, 99, 100)
END = 0
#: A segment is closed with the document that brings it to so many ids.
SEGMENT = 1 << 20
BATCH_BYTES = 2 << 20
#: Words that a worker remembers; unseen ones cost most of the time.
WORDS_HELD = 700_000
#: Words that the library encodes as one text.
TOGETHER = 512
INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "<u2"), ("exceptions", "<u2")])


def _words(width: int) -> int:
    return BLOCK * width // 64


def pack(ids: np.ndarray) -> bytes:
    """The payload of a segment's ids, unsigned and below 2**32."""
    count = -(-len(ids) // BLOCK)
    rows = np.zeros((count, BLOCK), np.uint32)
    rows.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        rows[-1, len(ids) % BLOCK :] = ids[-1]
    index = np.zeros(count, INDEX)
    least = rows.min(axis=1) if count else np.zeros(0, np.uint32)
    rows -= least[:, None]
    bits = np.frexp(rows.astype(np.float64))[1].astype(np.uint8)
    ordered = np.sort(bits, axis=1)
    choices = np.stack([ordered[:, min(BLOCK - 1, BLOCK * p // 100)] for p in PERCENTILES], axis=1)
    above = np.stack([np.count_nonzero(bits > c[:, None], axis=1) for c in choices.T], axis=1)
    pick = (choices.astype(np.int64) * (BLOCK // 8) + above * 6).argmin(axis=1)
    width = choices[np.arange(count), pick].astype(np.int64)
    index["least"], index["width"], index["exceptions"] = least, width, above[np.arange(count), pick]
    sizes = width * (BLOCK // 8) + index["exceptions"].astype(np.int64) * 6
    starts = np.cumsum(sizes) - sizes
    index["start"] = starts
    body = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        here = np.flatnonzero(width == w)
        low = np.ascontiguousarray((rows[here] & np.uint32((1 << int(w)) - 1)).T.astype(np.uint64))
        packed = np.zeros((_words(w) + 1, len(here)), np.uint64)
        for j in range(BLOCK if w else 0):
            word, shift = divmod(j * int(w), 64)
            packed[word] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                packed[word + 1] |= low[j] >> np.uint64(64 - shift)
        flat = np.ascontiguousarray(packed[:-1].T).astype("<u8").view(np.uint8).reshape(len(here), -1)
        body[(starts[here, None] + np.arange(flat.shape[1])).ravel()] = flat.ravel()
    block, place = np.nonzero(bits > width[:, None])
    if len(block):
        high = (rows[block, place] >> width[block].astype(np.uint32)).astype("<u4")
        first = np.searchsorted(block, block)  # of the block's exceptions
        nth, total = np.arange(len(block)) - first, index["exceptions"][block].astype(np.int64)
        base = starts[block] + width[block] * (BLOCK // 8)
        body[(base + nth * 2)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(base + total * 2 + nth * 4)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return np.array([len(ids), count], "<u8").tobytes() + index.tobytes() + body.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids first to last - 1 of a payload, all by default. Only the blocks that hold them are read, at the places that the index names."""
    size, count = (int(x) for x in np.frombuffer(payload, "<u8", 2))
    last = size if last is None else min(last, size)
    index = np.frombuffer(payload, INDEX, count, 16)
    body = np.frombuffer(payload, np.uint8, offset=16 + index.nbytes)
    from_block = first // BLOCK
    index = index[from_block : -(-last // BLOCK)]
    rows = np.zeros((len(index), BLOCK), np.uint32)
    starts, width = index["start"].astype(np.int64), index["width"].astype(np.int64)
    for w in np.unique(width):
        here = np.flatnonzero(width == w)
        if not w:
            continue
        flat = body[starts[here, None] + np.arange(_words(w) * 8)]
        packed = np.ascontiguousarray(flat.view("<u8").reshape(len(here), -1).T)
        values, mask = np.empty((BLOCK, len(here)), np.uint32), np.uint64((1 << int(w)) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * int(w), 64)
            row = packed[word] >> np.uint64(shift)
            if shift + w > 64:
                row |= packed[word + 1] << np.uint64(64 - shift)
            values[j] = row & mask
        rows[here] = values.T
    total = index["exceptions"].astype(np.int64)
    block = np.repeat(np.arange(len(index)), total)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(total) - total, total)
        base = starts[block] + width[block] * (BLOCK // 8)
        place = body[(base + nth * 2)[:, None] + np.arange(2)].view("<u2").ravel()
        high = body[(base + total[block] * 2 + nth * 4)[:, None] + np.arange(4)].view("<u4").ravel()
        rows[block, place] |= high << width[block].astype(np.uint32)
    rows += index["least"][:, None]
    return rows.ravel()[first - from_block * BLOCK : last - from_block * BLOCK]


class LibraryEncoder(bpe.Encoder):
    """Cuts many texts into words at once and has the library encode the words that it has not seen."""

    def __init__(self, path: str):
        super().__init__(path)
        rng = np.random.default_rng(7)
        self.values = rng.integers(1, 2**63, len(KINDS), np.uint64)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        whole = [bool(bpe.BEYOND_LATIN.search(t) or (self.cut and self.cut.search(t))) for t in texts]
        kept = [t for t, w in zip(texts, whole, strict=True) if not w]
        lengths = np.array([len(t) for t in kept], np.int64)
        joined = "".join(kept)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.cut_words(joined, points, np.cumsum(lengths))
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        first, number = words.distinct(points.astype(np.uint16), starts, ends, words.names(self.values[points], starts, ends))
        begin, end = starts[first].tolist(), ends[first].tolist()
        distinct = [joined[a:b] for a, b in zip(begin, end)]
        table = bpe.Offsets(self.looked_up(distinct), np.uint32)
        ids = table.take(number)
        stops = np.concatenate([[0], np.cumsum(table.size[number])])[np.searchsorted(starts, np.cumsum(lengths))] if len(number) else np.zeros(len(kept), np.int64)
        parts = iter(np.split(ids, stops[:-1])) if kept else iter(())
        out = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else next(parts) for t, w in zip(texts, whole, strict=True)]
        self.memory.trim(WORDS_HELD)
        return out

    def looked_up(self, some: list[str]) -> list[bytes]:
        """The ids of words."""
        found = list(map(self.memory.get, some))
        unseen = [k for k, x in enumerate(found) if x is None]
        if unseen:
            self.learn([some[k] for k in unseen])
            for k in unseen:
                found[k] = self.memory[some[k]]
        return found

    def learn(self, unseen: list[str]) -> None:
        """Has the library encode words that are not known yet.

        Words of a space and something else are cut from each other wherever they stand, so many of them go as one text, and the lengths of
        the tokens tell where each word's end.
        """
        spaced, alone = [], []
        for w in unseen:
            (spaced if w[0] == " " and len(w) > 1 and not w[-1].isspace() else alone).append(w)
        parts = [spaced[k : k + TOGETHER] for k in range(0, len(spaced), TOGETHER)]
        for part, x in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False) if parts else (), strict=True):
            ids = np.array(x.ids, np.uint32)
            cuts = words.token_cuts(self.decoded.size[ids], part)
            if cuts is None:
                alone += part
                continue
            raw = ids.tobytes()
            self.memory.update(zip(part, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else ()
        for word, x in zip(alone, found, strict=True):
            self.memory[word] = array("I", x.ids).tobytes()

    def cut_words(self, text: str, points: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where the words of texts that lie end to end start: the byte-level rule for Latin letters.

        A word is a run of letters, digits or other characters with the blank before it; of more white space the last character stands
        apart from the others, and an apostrophe that starts a word takes a contraction's letters with it.
        """
        size = len(points)
        if not size:
            return np.zeros(0, np.int64)
        kinds = KINDS[points]
        fresh = np.zeros(size + 1, bool)  # starts of texts
        fresh[0] = True
        fresh[stops] = True
        start = fresh[:-1].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        last = np.ones(size, bool)  # last characters of runs
        last[:-1] = start[1:]
        closing = np.flatnonzero(last & (kinds == BLANK) & ~fresh[1:])  # white space before a word
        start[closing] = True
        start[closing[points[closing] == 32] + 1] = False
        for at in np.flatnonzero((points[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER) & ~fresh[1:-1]).tolist():
            taken = CONTRACTION.match(text, at)
            stop = taken.end() if taken else at
            if taken and not fresh[at + 2 : stop].any():
                start[at + 1 : stop] = False
                if stop < size:
                    start[stop] = True
        return np.flatnonzero(start)


#: Kinds of characters below U+0250.
OTHER, LETTER, DIGIT, BLANK = range(4)
_kind = {LETTER: re.compile(f"[{bpe.LETTERS}]"), DIGIT: re.compile(f"[{bpe.DIGITS}]"), BLANK: re.compile(f"[{bpe.BLANKS}]")}
KINDS = np.array([next((k for k, p in _kind.items() if p.match(chr(c))), OTHER) for c in range(0x250)], np.uint8)
CONTRACTION = re.compile("'(?:[sdmt]|ll|ve|re)")


_held: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        _held[path] = LibraryEncoder(path)
    return _held[path]


FILE_SCHEMA = "shard int, segment int, first_id long, doc_ids array<long>, sizes array<long>, payload binary"


def write(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> Table:
    """Encodes docs and writes them as a table of segments: shard, segment, the number of the first id in the shard, documents, payload."""

    def run(batches):
        tool, shard = library_encoder(path or bpe.tokenizer_file(name)), TaskContext.get().partitionId()
        ids, names, held, segment, before = [], [], 0, 0, 0

        def close():
            sizes = [len(x) for x in ids]
            row = [[shard], [segment], [before], [names], [sizes], [pack(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=columns)

        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                encoded = tool.encode_all([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                    ids.append(np.append(found, np.uint32(END)))
                    names.append(doc_id)
                    held += len(ids[-1])
                    if held >= SEGMENT:
                        yield close()
                        ids, names, segment, before, held = [], [], segment + 1, before + held, 0
        if ids:
            yield close()

    columns = ["shard", "segment", "first_id", "doc_ids", "sizes", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return Table(rows.mapInArrow(run, FILE_SCHEMA))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    totals = files.groupBy("shard").agg(F.max(F.col("first_id") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases, at = {}, 0
    for r in totals.orderBy("shard").collect():  # one row per shard
        bases[r.shard], at = at, at + r.n

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, _, first, names, sizes, payload = (batch.column(c)[row].as_py() for c in range(6))
                ids, ends = unpack(payload).astype("<u4"), np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes, ends)]
                start = pa.array(bases[shard] + first + ends - np.array(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), start, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (with the end id) of the documents that `wanted` (doc_id) names: only their blocks are unpacked."""
    at = files.select(F.posexplode("doc_ids").alias("nth", "doc_id"), "shard", "segment", "sizes")
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda a, x: a + x)
    places = at.join(wanted.select("doc_id").distinct(), "doc_id").select("shard", "segment", F.struct("doc_id", before.alias("first"), F.get("sizes", F.col("nth")).alias("size")).alias("place"))
    rows = files.select("shard", "segment", "payload").join(places.groupBy("shard", "segment").agg(F.collect_list("place").alias("places")), ["shard", "segment"])

    def run(batches):
        for batch in batches:
            for payload, found in zip(batch.column("payload"), batch.column("places").to_pylist(), strict=True):
                ids = [unpack(payload.as_py(), p["first"], p["first"] + p["size"]).tolist() for p in found]
                yield pa.RecordBatch.from_arrays([pa.array([p["doc_id"] for p in found], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return rows.select("payload", "places").mapInArrow(run, "doc_id long, ids array<long>")


def op7_token_binary(spark, sf_dir: str) -> DataFrame:
    files = write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    try:
        return settled(read(files.read()))
    finally:
        files.drop()
