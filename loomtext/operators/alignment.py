"""Similarity of two texts from the vectors of their tokens: each token is matched with the one of the other text that it is closest to.

Precision is the mean of the candidate's greatest cosines, recall that of the reference's, weighted by token; the F score is their
harmonic mean. Weights can come from a corpus (`idf`), and each value can be moved so that `baseline` becomes 0 and 1 stays 1.

Cosines of a pair are computed in blocks of BLOCK by BLOCK tokens, so texts of any length take bounded memory beyond their own vectors.

Cases: null arrays give null; a side without tokens gives 0 before the baseline; null vectors and those without length have cosine 0
with all; weights that are null count 1, and weights that sum to 0 give 0; repeated rows are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLOCK = 1024
#: Tokens with a weight of their own that are broadcast (some 16 bytes each).
TOKENS_BROADCAST = 1_000_000
_RESULT = pa.struct([("precision", pa.float64()), ("recall", pa.float64()), ("f1", pa.float64())])


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1, or 0 where a vector is null or has none."""
    sizes = [len(v) if v.is_valid else 0 for v in vectors]
    out = np.zeros((len(sizes), max(sizes, default=0)))
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(set(sizes) - {0}) > 1:
        raise ValueError("vectors of one text have different dimensions")
    out[[k for k, n in enumerate(sizes) if n]] = flat.reshape(-1, out.shape[1]) if out.size else flat.reshape(0, 0)
    out = np.nan_to_num(out)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def best_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest cosine of each row of a with one of b, and of each row of b with one of a."""
    for_a, for_b = np.full(len(a), -1.0), np.full(len(b), -1.0)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            block = a[i : i + BLOCK] @ b[j : j + BLOCK].T
            np.maximum(for_a[i : i + BLOCK], block.max(axis=1), out=for_a[i : i + BLOCK])
            np.maximum(for_b[j : j + BLOCK], block.max(axis=0), out=for_b[j : j + BLOCK])
    return for_a, for_b


def scores(reference: np.ndarray, candidate: np.ndarray, reference_weights=None, candidate_weights=None, baseline=(0.0, 0.0, 0.0)) -> tuple[float, float, float]:
    """Precision, recall and F of unit vectors."""
    p = r = f = 0.0
    if len(reference) and len(candidate):
        width = max(reference.shape[1], candidate.shape[1])
        # A side of nulls only has no dimension of its own.
        reference, candidate = (x if x.shape[1] else np.zeros((len(x), width)) for x in (reference, candidate))
        if reference.shape[1] != candidate.shape[1]:
            raise ValueError("the texts' vectors have different dimensions")
        for_candidate, for_reference = best_matches(candidate, reference)
        mean = lambda x, w: float(x @ w / w.sum()) if w.sum() > 0 else 0.0
        p = mean(for_candidate, np.ones(len(candidate)) if candidate_weights is None else candidate_weights)
        r = mean(for_reference, np.ones(len(reference)) if reference_weights is None else reference_weights)
        f = 2 * p * r / (p + r) if p + r else 0.0
    return tuple((x - b) / (1 - b) for x, b in zip((p, r, f), baseline, strict=True))


def matched(reference: Column, candidate: Column, reference_weights: Column | None = None, candidate_weights: Column | None = None, baseline: tuple = (0.0, 0.0, 0.0)) -> Column:
    """Struct of precision, recall and f1 from arrays of token vectors, and of weights where there are some."""

    def weights_of(column, k: int, n: int):
        if column is None or not column[k].is_valid:
            return None
        w = np.array([1.0 if x is None else x for x in column[k].as_py()], np.float64)
        if len(w) != n:
            raise ValueError(f"{n} tokens have {len(w)} weights")
        return w

    def of(reference, candidate, *weights):
        first, second = weights if weights else (None, None)
        out = []
        for k in range(len(reference)):
            if not (reference[k].is_valid and candidate[k].is_valid):
                out.append(None)
                continue
            a, b = unit_rows(reference[k].values), unit_rows(candidate[k].values)
            out.append(dict(zip(("precision", "recall", "f1"), scores(a, b, weights_of(first, k, len(a)), weights_of(second, k, len(b)), baseline), strict=True)))
        return pa.array(out, _RESULT)

    kind = "precision double, recall double, f1 double"
    if reference_weights is None and candidate_weights is None:

        @arrow_udf(kind)
        def plain(reference: pa.Array, candidate: pa.Array) -> pa.Array:
            return of(reference, candidate)

        return plain(reference, candidate)

    @arrow_udf(kind)
    def weighted(reference: pa.Array, candidate: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return of(reference, candidate, first, second)

    none = F.lit(None).cast("array<double>")
    return weighted(reference, candidate, none if reference_weights is None else reference_weights, none if candidate_weights is None else candidate_weights)


def idf(references: DataFrame, ids: str) -> tuple[DataFrame, int]:
    """(token, weight) of the references' tokens, and the number of references: ln((n + 1) / (documents with the token + 1))."""
    n = references.count()
    each = references.select(F.explode(F.array_distinct(ids)).alias("token")).filter("token is not null")
    return each.groupBy("token").agg((F.log(F.lit(n + 1.0)) - F.log(F.count("*") + 1.0)).alias("weight")), n


def with_idf(df: DataFrame, table: DataFrame, n: int, key: list[str], ids: str, into: str) -> DataFrame:
    """Adds the array of weights of the tokens in `ids`; tokens that the table lacks weigh as if in no document.

    Up to TOKENS_BROADCAST weights, counted beforehand, are broadcast. More are joined by token, and put together by the rows' key again.
    """
    absent = math.log(n + 1.0)
    if table.limit(TOKENS_BROADCAST + 1).count() <= TOKENS_BROADCAST:
        known = df.sparkSession.sparkContext.broadcast({r.token: r.weight for r in table.collect()})

        @arrow_udf("array<double>")
        def weigh(column: pa.Array) -> pa.Array:
            weights = known.value
            flat = pa.array([weights.get(t, absent) for t in column.flatten().to_pylist()], pa.float64())
            sizes = [len(x) if x.is_valid else None for x in column]
            ends = np.cumsum([0, *(s or 0 for s in sizes)])
            return pa.ListArray.from_arrays(pa.array([None if s is None else e for s, e in zip([*sizes, 0], ends.tolist())], pa.int32()), flat)

        return df.withColumn(into, weigh(F.col(ids)))
    each = df.select(*key, F.posexplode(ids).alias("_at", "token")).join(table, "token", "left")
    each = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("weight", F.lit(absent)).alias("w")))).alias("_w"))
    found = each.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.transform("_w", lambda x: x["w"]).alias(into))
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(found, same, "left").drop(*[f"_key_{k}" for k in key])
