"""Fill-in-middle transformation, with cuts found by a sparse index of checkpoints.

A text is counted once: a unit is a word with the white space before it, and white space at the end is a unit of its own. While counting,
every STRIDE units a checkpoint notes the byte and the code point at which the next unit starts. The two cuts are drawn from the number of
units; each is found by a binary search among the checkpoints and a short scan of the bytes that follow, so the text is neither split
into units nor read again from its start.

Draws come from the SHA-256 of the seed and the doc_id, so reruns agree and rows may lie in any partition. With `form` psm the output is
<P>prefix<S>suffix<M>middle, with spm <S>suffix<P>prefix<M>middle, with plain the text itself. A text that holds one of the marks stays
plain, so `restored` gets every text back from the output and its form.

Cases: a null text is an empty one, and plain; a null doc_id is drawn for as an empty string; rows that share a doc_id are drawn for alike
and cut each; texts of any length are transformed whole; an empty table gives an empty result; other columns are not read by
`transformed`, and kept under any name by `fill_middle`.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import in_small_batches, sub_batches, with_row

BATCH_BYTES = 2 << 20
#: Units between two checkpoints.
STRIDE = 256
SEED = 42
#: Shares in per cent: of texts that are transformed, and among them of those in the form spm.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Checkpoints:
    """The number of units of a text, and where every STRIDE-th one starts: units, bytes and code points before it."""

    def __init__(self, text: bytes, stride: int = STRIDE):
        self.text = text
        data = np.frombuffer(text, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1  # of words
        self.units = len(ends) + bool(len(data) and blank[-1])
        at = np.concatenate([[0], ends[stride - 1 : self.units - 1 : stride]]).astype(np.int64)
        opens = ((data & 0xC0) != 0x80).astype(np.int64)  # first bytes of code points
        self.counts = list(range(0, stride * len(at), stride))
        self.bytes = at.tolist()
        self.points = np.concatenate([[0], np.cumsum(np.add.reduceat(opens, at)[:-1])]).tolist() if len(data) else [0]

    def cut(self, units: int) -> tuple[int, int]:
        """The bytes and the code points that the first `units` units take."""
        near = bisect.bisect_right(self.counts, units) - 1
        left, start = units - self.counts[near], self.bytes[near]
        stop = start
        for _ in range(left):
            stop = UNIT.match(self.text, stop).end()
        return stop, self.points[near] + len(self.text[start:stop].decode())


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(text: str, doc_id, seed: int = SEED, rate: int = RATE, spm: int = SPM, stride: int = STRIDE) -> tuple:
    """Number of units, form, code points of prefix and middle (None if plain), and the output in UTF-8."""
    raw = text.encode()
    index = Checkpoints(raw, stride)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return index.units, "plain", None, None, raw
    low, high = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    (a, before), (b, until) = index.cut(low), index.cut(high)
    parts = {PREFIX: raw[:a], MIDDLE: raw[a:b], SUFFIX: raw[b:]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return index.units, form, before, until - before, b"".join(mark.encode() + parts[mark] for mark in order)


def restored(output: bytes, form: str) -> bytes:
    """The text from an output and its form."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    parts, rest = {}, output[len(order[0]) :]
    for mark, following in zip(order, order[1:]):
        parts[mark], _, rest = rest.partition(following.encode())
    parts[order[-1]] = rest
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def transformed(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The carried columns, n, form, prefix_chars, middle_chars and output of each row; doc_id and text are read."""
    other = "_".join(carried)  # longer names than theirs clash with none
    rows = in_small_batches(docs).select(*carried, F.col("doc_id").cast("string").alias(f"{other}_id"), F.col("text").alias(f"{other}_text"))
    id_at, text_at = len(carried), len(carried) + 1
    schema = T.StructType([docs.schema[c] for c in carried])
    for name, kind in zip(NAMES, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for whole in batches:
            for batch in sub_batches(whole, text_at, BATCH_BYTES):
                ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
                found = zip(*(transform(t or "", i, seed, rate, spm) for i, t in zip(ids, texts, strict=True)))
                columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:id_at], *columns[:-1], columns[-1].cast(pa.string())], names=[*carried, *NAMES])

    return rows.mapInArrow(run, schema)


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The rows of docs with transformed texts; all other columns stay as they are."""
    rows = with_row(docs, "doc_id", "text").withColumn("row", F.col("row").dropFields("text"))
    out = transformed(rows, ("row",), seed, rate, spm)
    return out.select(*[F.col("output" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, "output", BATCH_BYTES):
                forms, outputs = batch.column("form").to_pylist(), batch.column("output").to_pylist()
                pairs = [(o.encode(), f) for o, f in zip(outputs, forms, strict=True)]
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in row], pa.string()) for row in ([o for o, _ in pairs], [restored(o, f) for o, f in pairs])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *digests], names=[*batch.schema.names[:-1], "output_sha256", "restored_sha256"])

    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def oracle_sql() -> str:
    """DuckDB SQL for op13_fill_in_middle: lists of units, joined anew."""
    return rf"""
with d as (
  select doc_id, coalesce(text, '') t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u from documents),
n as (select *, len(u) n, [('0x' || h[8 * k + 1:8 * k + 8])::bigint for k in range(0, 4)] r from d),
c as (
  select *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or r[3] % 100 >= {RATE} then 'plain' when r[4] % 100 < {SPM} then 'spm' else 'psm' end form from n),
p as (select *, array_to_string(u[1:a], '') x, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') z from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(x)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || m else '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || m end) output_sha256,
  sha256(t) restored_sha256 from p"""
