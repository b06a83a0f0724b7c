"""Exact top-k by inner product with no-random-access aggregation.

Vectors are cut into blocks by a hash of their ids and each block keeps one list per component, sorted by value. For a query the lists
are read in step, from the end that multiplies to large products. What has been read of a vector plus the lists' least products bounds
its score from below, plus the lists' present products from above. Vectors whose upper bound falls under the k-th lower bound leave;
reading stops when nothing outside the remaining few can qualify, and their final scores are resolved. A few queries find out from which
depth on bounds decide anything; the others are compared from there on.

Each block meets the queries in groups of QUERIES, so a task holds BLOCK vectors and QUERIES queries whatever the size of the input.
One block is searched first; its k-th score is a lower bound that the queries take along to all others. A block whose lists' ends
cannot reach it is left at once, and its vectors start from that bound. The best of each block are merged per query by a window that
limits rows before they are shuffled. Exact search by vectors without structure remains quadratic: every query's bounds meet every
block, and each block is copied once per QUERIES queries.

Cases: null vectors, vectors that hold null or non-finite components and rows without an id take no part; shorter vectors count as
padded with zeros; ties go to the smaller id; rows that share the query's id are the query's own and no candidates; of queries that
share an id the one with the least vector is asked; candidates that share an id are ranked each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import settled

K, EVERY = 5, 50
BLOCK, QUERIES = 4096, 8192
#: Queries that read a block's lists together.
TOGETHER = 1024
#: Shares of the lists after which the bounds are compared.
DEPTHS = (1 / 8, 1 / 2, 1)
#: Queries that try the depths first, and the share of vectors that may still qualify at the depth from which all others read.
PROBES, WORTHWHILE = 4, 1 / 16
#: Sums of whole numbers below it are exact as doubles.
EXACT = 2.0**53
#: Reading stops when so many times k vectors remain.
FEW = 8


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


class Lists:
    """The sorted lists of one block, read from both ends in step for many queries at once.

    What has been read lies in a table of two halves, for the ends of large values and for those of small ones, with zeros where a list has
    not come to a vector yet. A query multiplies its positive components with the former and its negative ones with the latter.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.floats = ids, vectors, vectors.astype(float)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0).astype(np.float64)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, id, score) of the k highest scores of each query, ties to smaller ids; scores under `least` may be left out.

        A few queries try all depths. The others start at the first one at which these had few vectors left: where bounds decide late,
        comparing them early would only cost time.
        """
        width = self.vectors.shape[1]
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float64)
        slack = np.abs(signed) @ np.abs(np.concatenate([self.values[0], self.values[-1]])) * 1e-12  # sums below EXACT are exact
        reach = signed[:, :width] @ self.values[-1] + signed[:, width:] @ self.values[0]
        left = np.flatnonzero(reach >= least - slack)
        ask = lambda some, depths: self.read(some, query_ids[some], queries[some], signed[some], least[some], slack[some], k, depths)
        found, shares = ask(left[:PROBES], DEPTHS)
        first = next((i for i, share in enumerate(shares) if share <= WORTHWHILE), len(DEPTHS) - 1)
        return found + ask(left[PROBES:], DEPTHS[first:])[0]

    def read(self, left, query_ids, queries, signed, least, slack, k: int, depths) -> tuple[list[tuple[int, int, int]], list[float]]:
        """The best of some queries, and the share of vectors that could still qualify after each depth."""
        count, width = self.vectors.shape
        ends, columns = np.concatenate([self.values[0], self.values[-1]]), np.arange(width)
        found, shares, left, here = [], [], np.arange(len(left)), np.arange(count)
        for depth in depths if len(left) else ():
            stop = max(1, int(count * depth))
            if stop == count:  # all lists are read: bounds are scores
                found += self.scored(here, query_ids[left], queries[left], least[left], k)
                break
            read, seen = np.zeros((count, 2 * width)), np.zeros((count, 2 * width))
            low, high = self.order[:stop], self.order[count - stop :]
            read[high, columns], seen[high, columns] = self.values[count - stop :], 1
            read[low, columns + width], seen[low, columns + width] = self.values[:stop], 1
            read, seen = read[here], seen[here]  # vectors that no query needs any more have left
            q, present = signed[left], np.concatenate([self.values[count - stop], self.values[stop - 1]])
            lower = q @ (read - ends * seen).T + (q @ ends)[:, None]
            upper = q @ (read - present * seen).T + (q @ present)[:, None]
            own = query_ids[left][:, None] == self.ids[here]
            lower[own] = -np.inf
            bound = least[left]
            if len(here) > k:
                bound = np.maximum(np.partition(lower, len(here) - k, axis=1)[:, len(here) - k], bound)
            alive = (upper >= (bound - slack[left])[:, None]) & ~own
            shares.append(float(alive.sum() / (len(left) * count)))
            # Nothing outside the remaining few can qualify: resolve their scores.
            done = alive.sum(axis=1) <= k * FEW
            for i in np.flatnonzero(done):
                found += self.first(query_ids[left[i]], queries[left[i]], here[alive[i]], least[left[i]], k)
            left, here = left[~done], here[alive[~done].any(axis=0)]
            if not len(left):
                break
        return found, shares

    def scored(self, here: np.ndarray, query_ids, queries, least, k: int) -> list[tuple[int, int, int]]:
        """The k best of the vectors `here` for each query, by their scores."""
        if not len(here) or float(np.abs(self.values[[0, -1]]).max() * np.abs(queries.astype(float)).sum(axis=1).max()) >= EXACT:
            return [x for i in range(len(queries)) for x in self.first(query_ids[i], queries[i], here[self.ids[here] != query_ids[i]], least[i], k)]
        scores, found = queries.astype(float) @ self.floats[here].T, []
        scores[query_ids[:, None] == self.ids[here]] = -np.inf
        bound = least if len(here) <= k else np.maximum(np.partition(scores, len(here) - k, axis=1)[:, len(here) - k], least)
        row, column = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))
        ids, values = self.ids[here[column]], scores[row, column].astype(np.int64)
        order = np.lexsort((ids, -values, row))
        row, ids, values = row[order], ids[order], values[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)  # ties beyond the k-th place are cut off
        keep = nth < k
        return list(zip(query_ids[row[keep]].tolist(), ids[keep].tolist(), values[keep].tolist()))

    def first(self, query_id: int, query: np.ndarray, rows: np.ndarray, least: float, k: int) -> list[tuple[int, int, int]]:
        """The k best of some vectors by their scores."""
        scores = self.resolve(rows, query)
        ordered = sorted(zip((-scores).tolist(), self.ids[rows].tolist()))[:k]
        return [(int(query_id), x, -s) for s, x in ordered if -s >= least]

    def resolve(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores in whole numbers; where 64 bits could overflow, Python's integers, cut off at the ends of a long."""
        most = np.abs(self.values[[0, -1]]).max(initial=0) * float(np.abs(query.astype(float)).sum())
        if most < EXACT:
            return (self.floats[rows] @ query.astype(float)).astype(np.int64)
        vectors = self.vectors[rows]
        if float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum()) < 2.0**62:
            return vectors @ query
        return np.clip(vectors.astype(object) @ query.astype(object), -(2**63) + 1, 2**63 - 1)


def as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of up to `width` whole numbers as rows."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of `vectors` (vec_id, v) for each of `queries` (query_id, q), v and q from `scaled`."""
    queries = queries.groupBy("query_id").agg(F.min("q").alias("q"))
    blocks = max(1, -(-vectors.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))
    right = queries.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("b", every(blocks))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list = []
        if rows.num_rows and asked.num_rows:
            width = max(max(map(len, c.to_pylist()), default=0) for c in (rows["v"], asked["q"]))
            lists = Lists(rows["vec_id"].to_numpy(), as_matrix(rows["v"], width))
            ids, q = asked["query_id"].to_numpy(), as_matrix(asked["q"], width)
            least = pc.fill_null(asked["least"].cast(pa.float64()), -np.inf).to_numpy()
            for at in range(0, len(ids), TOGETHER):
                part = slice(at, at + TOGETHER)
                found += lists.best(ids[part], q[part], least[part], k)
        return pa.table({n: pa.array([x[i] for x in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def meet(vectors: DataFrame, queries: DataFrame) -> DataFrame:
        return vectors.groupBy("b", "g").cogroup(queries.groupBy("b", "g")).applyInArrow(run, "query_id long, vec_id long, score long")

    first = settled(meet(left.filter("b = 0"), right.filter("b = 0").withColumn("least", F.lit(None).cast("long"))))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    best = first.union(meet(left.filter("b > 0"), right.filter("b > 0").join(bounds, "query_id", "left")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled(F.col("embedding")).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))


def oracle_sql() -> str:
    """DuckDB SQL for op9_topk_search: all scores, the best kept."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
asked as (select vec_id, min(e) e from v where vec_id % {EVERY} = 0 group by vec_id),
scores as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from asked q join v c on q.vec_id <> c.vec_id)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scores) where rank <= {K}"""
