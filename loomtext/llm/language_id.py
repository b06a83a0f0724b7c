"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its class number. A three-letter gram binds its letters: it multiplies the
first one's vector rotated by two, the second one's rotated by one and the third one's. A text's vector bundles (adds) those of its
grams, and a language's prototype those of its learning texts. A text gets the language whose prototype has the largest cosine.

Bundling is linear, so texts and languages are first counted by gram, and the counts are multiplied by the grams' vectors once: the
prototypes come from a table of at most GRAMS rows per language, and texts in a batch share the vectors of their grams.

Letters are Unicode letters in lower case. a to z have classes of their own, all others share the rest by code point; any other
character ends a word, and grams reach across one such end, so that starts and ends of words count.

Cases: a null text and one without letters are `und` with score 0; so is every text if nothing can be learned; rows with a null
language teach nothing; of equal cosines the first language by name wins; repeated rows are judged each; texts of any length are read
whole; an empty table gives an empty result; lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import in_small_batches, settled, sub_batches

SIZE = 1024
CLASSES, OWN = 64, 27
GRAMS = CLASSES**3
SEED = 20_240
BATCH_BYTES = 1 << 20
#: Languages whose prototypes are broadcast at once, SIZE numbers each; TOGETHER of them are counted at once in a task.
LANGUAGES, TOGETHER = 2_000, 64


@cache
def letter_classes() -> np.ndarray:
    """Class by code point; 0 is no letter. The lower case of a letter has its class."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low < 123 else OWN + (low * 40_503 >> 4) % (CLASSES - OWN)
    return out


@cache
def letter_vectors() -> np.ndarray:
    """The classes' vectors, rotated by 2, 1 and 0."""
    plain = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, SIZE))
    return np.stack([np.roll(plain, k, axis=1) for k in (2, 1, 0)])


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    two, one, none = letter_vectors()
    return (two[grams // CLASSES**2] * one[grams // CLASSES % CLASSES] * none[grams % CLASSES]).astype(np.float32)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the grams with a letter in each text, and each text's number of letters."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_classes()[points].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner[kinds > 0], minlength=len(texts))
    # One blank before and after each text, and of blanks in a row only the first.
    kinds = np.insert(kinds, np.concatenate([[0], np.cumsum(lengths)]), 0)
    owner = np.insert(owner, np.concatenate([[0], np.cumsum(lengths)]), np.append(np.arange(len(texts)), len(texts)))
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0)
    kinds, owner = kinds[keep], owner[keep]
    grams = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
    # A gram is its middle letter's; blanks in the middle join two words.
    whose = owner[1:-1]
    inside = (kinds[1:-1] > 0) & (whose < len(texts))
    both, counts = np.unique(whose[inside] * GRAMS + grams[inside], return_counts=True)
    return both // GRAMS, both % GRAMS, counts, letters


def learns(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def prototypes(docs: DataFrame) -> DataFrame:
    """lang and the sums of its learning texts' vectors (v), from the rows with a language and text."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}

        def closed():
            for lang, total in sums.items():
                used = np.flatnonzero(total)
                vector = np.zeros(SIZE)
                for k in range(0, len(used), 4096):
                    vector += total[used[k : k + 4096]] @ gram_vectors(used[k : k + 4096]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * SIZE, pa.string()), pa.array(range(SIZE), pa.int32()), pa.array(vector.astype(np.int64))], names=["lang", "place", "sum"])
            sums.clear()

        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
                rows, grams, counts, _ = gram_counts(texts)
                for lang in set(langs.tolist()):
                    if lang not in sums and len(sums) >= TOGETHER:
                        yield from closed()
                    here = langs[rows] == lang
                    total = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                    np.add.at(total, grams[here], counts[here])
        yield from closed()

    parts = in_small_batches(docs).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(bundle, "lang string, place int, sum long")
    sums = parts.groupBy("lang", "place").agg(F.sum("sum").alias("sum")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "sum"))).alias("v"))
    return settled(sums.select("lang", F.transform("v", lambda x: x["sum"]).alias("v")))


def blocks(learned: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and prototypes of length 1 of some LANGUAGES languages each, so that the driver holds one block at a time."""
    count = max(1, -(-learned.count() // LANGUAGES))
    part = F.pmod(F.xxhash64("lang"), F.lit(count))
    for k in range(count):
        rows = (learned.filter(part == k) if count > 1 else learned).toArrow().sort_by("lang")
        table = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE).astype(float)
        length = np.linalg.norm(table, axis=1)
        names = [x for x, n in zip(rows["lang"].to_pylist(), length) if n]
        yield names, (table[length > 0] / length[length > 0, None]).astype(np.float32)


def predict(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of each row.

    More languages than one block holds take one pass over the texts per block; each passes on the best so far.
    """
    schema = T.StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double")
    out = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(-2.0).alias("score"))
    for names, table in blocks(learned):
        out = better(out, names, table)
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score")).to(schema)


def better(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """The same rows with lang_pred and score of a block's languages where these are closer, or as close and earlier by name."""
    held = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches):
        langs, table = held.value
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows, grams, counts, letters = gram_counts(texts)
                used, column = np.unique(grams, return_inverse=True)
                vectors = np.zeros((len(texts), SIZE), np.float32)
                for k in range(0, len(used), 4096):  # so many grams' vectors at once
                    here = (column >= k) & (column < k + 4096)
                    weights = np.zeros((len(texts), min(4096, len(used) - k)), np.float32)
                    weights[rows[here], column[here] - k] = counts[here]
                    vectors += weights @ gram_vectors(used[k : k + 4096])
                size = np.linalg.norm(vectors, axis=1)
                known = (letters > 0) & (size > 0) & (len(langs) > 0)
                scores = (vectors @ table.T) / np.maximum(size, 1e-9)[:, None] if langs else np.zeros((len(texts), 1))
                top = scores.max(axis=1).astype(float)
                best, so_far = [], zip(known.tolist(), scores.argmax(axis=1).tolist(), top.tolist(), batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist())
                for ok, k, score, name, other in so_far:
                    mine = ok and (name is None or score > other or (score == other and langs[k] < name))
                    best.append((langs[k], score) if mine else (name, other))
                columns = [pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, prototypes(docs.filter(learns(F.col("doc_id")))))
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
