"""Chunks of documents: paragraphs with offsets, merged groups, token windows, and putting documents together again.

All operate within a document's row (arrays, in order), so nothing is shuffled until rows are exploded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StructType

from loomtext.functions import constants as C
from loomtext.functions import text as T


def paragraphs(text: Column, breaks: str = "\n\n+") -> Column:
    """Array of (pos, text, start, end): parts between breaks that hold more than white space; offsets in code points, end exclusive."""
    whole = F.struct(F.split(text, breaks).alias("parts"), F.regexp_extract_all(text, F.lit(breaks), F.lit(0)).alias("breaks"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["parts"], lambda p, i: F.length(p) + F.coalesce(F.length(F.get(x["breaks"], i)), F.lit(0)))
        starts = T.let(sizes, T.sums_before)
        rows = T.let(starts, lambda s: F.transform(x["parts"], lambda p, i: F.struct(p.alias("text"), F.get(s, i).cast("int").alias("start"))))
        kept = F.filter(rows, lambda r: r["text"].rlike(r"\S"))
        return F.transform(kept, lambda r, i: F.struct(i.alias("pos"), r["text"].alias("text"), r["start"].alias("start"), (r["start"] + F.length(r["text"])).alias("end")))

    return F.when(text.isNotNull(), T.let(whole, placed))


def exploded(df: DataFrame, chunks: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.inline(chunks))


def merge_short(chunks: Column, least: int = C.MIN_PROSE) -> Column:
    """Groups of prose chunks, in order: array of (text, words, members).

    `chunks` holds (pos, kind, text, words) in order. A structural chunk ends the open group; a chunk of enough words ends it and stands
    alone; others gather until they have enough words together.
    """
    spans = merged_spans(F.transform(chunks, lambda c: c["kind"] == "prose"), F.transform(chunks, lambda c: c["words"].cast("int")), F.lit(least))

    def group(at: Column) -> Column:
        part = F.slice(chunks, at["first"] + 1, at["last"] - at["first"] + 1)
        words = F.aggregate(part, F.lit(0), lambda a, c: a + c["words"])
        return F.struct(F.array_join(F.transform(part, lambda c: c["text"]), " ").alias("text"), words.alias("words"), F.transform(part, lambda c: c["pos"]).alias("members"))

    return F.transform(spans, group)


@arrow_udf(ArrayType(StructType().add("first", "integer").add("last", "integer")))
def merged_spans(prose: pa.Array, words: pa.Array, least: pa.Array) -> pa.Array:
    """First and last chunk of each group: only flags and numbers of words leave the JVM, and each is looked at once."""
    out = []
    for kinds, counts, enough in zip(prose.to_pylist(), words.to_pylist(), least.to_pylist()):
        spans, first, held = [], None, 0
        for k, (is_prose, n) in enumerate(zip(kinds or (), counts or ())):
            if first is not None and (not is_prose or n >= enough):
                spans.append({"first": first, "last": k - 1})
                first, held = None, 0
            if not is_prose:
                continue
            first, held = k if first is None else first, held + n
            if held >= enough:
                spans.append({"first": first, "last": k})
                first, held = None, 0
        if first is not None:
            spans.append({"first": first, "last": len(kinds) - 1})
        out.append(None if kinds is None else spans)
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


def fanned_out(groups: DataFrame, results: DataFrame, *keys: str, group: str = "group_no", members: str = "members") -> DataFrame:
    """A row for each member of each group, with its group's results: keys, pos and the columns of `results` (keys, group, ...).

    Groups without a result keep their members, with nulls.
    """
    rows = groups.select(*keys, group, F.explode(members).alias("pos"))
    return rows.join(results, [*keys, group], "left")


def token_windows(count: Column, size: int = C.WINDOW, stride: int = C.STRIDE) -> Column:
    """Starts of the windows over so many tokens: one if they fit, else every stride until the end is reached."""
    last = F.greatest(F.ceil((count - size) / stride), F.lit(0)) * stride
    return F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))


def splice(text: Column, changes: Column) -> Column:
    """Puts (start, end, text) changes into a text, last one first, so that offsets stay right. Offsets in code points, end exclusive."""
    backwards = F.reverse(F.array_sort(changes))
    return F.aggregate(backwards, text, lambda t, c: F.concat(F.substring(t, F.lit(1), c["start"]), c["text"], F.substring(t, c["end"] + 1, F.length(t))))


def splice_lines(text: Column, changes: Column) -> Column:
    """The same for changes that count lines."""
    backwards = F.reverse(F.array_sort(changes))
    lines = F.aggregate(
        backwards, F.split(text, "\n"),
        lambda t, c: F.concat(F.slice(t, F.lit(1), c["start"]), F.split(c["text"], "\n"), F.slice(t, c["end"] + 1, F.greatest(F.size(t) - c["end"], F.lit(0)))),
    )
    return F.array_join(lines, "\n")


def chunk_id(doc_id: Column, start: Column, end: Column) -> Column:
    """A name that reruns agree on."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), start.cast("string"), end.cast("string")), 256)
