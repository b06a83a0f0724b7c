"""Documents of several formats: parsed by format, checked, and written back with their changes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import chunks as O
from loomtext.operators import markup


def plain_chunks(text: str) -> Iterator[tuple]:
    """Paragraphs of a plain text between runs of empty lines, all of them prose, by code points."""
    breaks = [(m.start(), m.end()) for m in re.finditer("\n\n+", text)]
    spans = zip([0, *(end for _, end in breaks)], [*(start for start, _ in breaks), len(text)], strict=True)
    for pos, (start, end) in enumerate((a, b) for a, b in spans if text[a:b].strip()):
        yield pos, "prose", start, end, text[start:end], {}


PARSERS = {"latex": markup.latex_chunks, "markdown": markup.markdown_chunks, "plaintext": plain_chunks}


def parsed(docs: DataFrame, *keys: str, parsers: dict | None = None, prose_envs: tuple[str, ...] = (), structural_macros: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of each document (format, text), by its format's parser, with the named columns. Another format is an error.

    prose_envs and structural_macros are LaTeX environments and macros beyond those that are known.
    """
    known = dict(parsers or PARSERS)
    if prose_envs or structural_macros:
        known["latex"] = partial(known["latex"], prose_envs=prose_envs, structural_macros=structural_macros)
    odd = F.raise_error(F.concat(F.lit("no parser for format "), F.coalesce("format", F.lit("null"))))
    rows = docs.select(*keys, F.when(F.col("format").isin(*known), F.col("format")).otherwise(odd).alias("format"), "text")
    return markup.parsed_rows(rows, keys, ["format", "text"], lambda kind, text: known[kind](text or ""))


def prose(chunks: DataFrame) -> DataFrame:
    """The chunks that can be scored and rewritten."""
    return chunks.filter(F.col("kind") == "prose")


def rebuilt(docs: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, format, text) with the new texts of `changes` (key, start, end, text) in place; Markdown counts lines, others code points."""
    marks = changes.groupBy(key).agg(F.collect_list(F.struct("start", "end", "text")).alias("_marks"))
    out = docs.join(marks, key, "left")
    new = F.when(F.col("format") == "markdown", O.splice_lines(F.col("text"), F.col("_marks"))).otherwise(O.splice(F.col("text"), F.col("_marks")))
    return out.withColumn("text", F.when(F.col("_marks").isNotNull(), new).otherwise(F.col("text"))).drop("_marks")


def output_path(path: Column) -> Column:
    """Where a changed document goes: beside the original, with _transformed after its stem."""
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.lit("_transformed"), F.regexp_extract(path, r"(\.[^./]*)?$", 1))


def write_documents(docs: DataFrame) -> DataFrame:
    """Writes each text to its path, a URI that all executors reach, and returns path and bytes written.

    A file is written under another name and moved, so a task that is run again leaves no part of one.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path, text in batch[["path", "text"]].itertuples(index=False):
                system, place = fs.FileSystem.from_uri(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                data = (text or "").encode()
                with system.open_output_stream(part := f"{place}.{uuid.uuid4().hex}") as f:
                    f.write(data)
                system.move(part, place)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "size": sizes})

    return docs.select("path", "text").mapInPandas(run, "path string, size long")


def unescaped_dollars(text: Column) -> Column:
    """Dollar signs outside code that no backslash precedes."""
    plain = F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", ""), "`[^`]+`", "")
    return F.regexp_count(plain, F.lit(r"(?<!\\)\$"))


def markdown_error(text: Column) -> Column:
    """What is wrong with a Markdown text, or null: an odd number of formula delimiters. Any text parses, so nothing else can be."""
    n = unescaped_dollars(text)
    return F.when(n % 2 != 0, F.format_string("Unbalanced $ delimiters: %d found (odd count)", n))
