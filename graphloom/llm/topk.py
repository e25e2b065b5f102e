"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries and vectors are dealt into blocks; a cell joins one block of each. In a cell each dimension's values are
sorted once. Every query goes down its own ends of the lists, from the top where its component is positive and from
the bottom where it is negative, and deepest where its contributions are largest. Vectors seen for the first time
are scored in full. A query stops when no unseen vector can reach its kth score: the sum, over dimensions, of its
component times the value at which its list stands is below it. The kth score runs on from cell to cell: each query
first searches one block of vectors, and takes the kth score found there into all others. Cells return k rows a
query at most, which a last aggregation merges.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a cell: a block of vectors and a block of queries.
VECTORS, QUERIES = 8192, 4096
#: The lists that a step goes down are a query's PART-th with the largest contributions; by a DEPTH-th of their length.
PART, DEPTH, LEAST_DEPTH = 4, 64, 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): floor(256 * component, as double); vectors null or with null or non-finite components are left out."""
    x = F.col(vector_col)
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False))
    return vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("x"))


def cell_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, low: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query row, vector id, score) of each query's k best vectors of the cell, and how many each query has scored.

    Ties go to smaller ids; vectors with the query's id are left out, and those that score below its `low`, where
    k better ones are known from elsewhere (the least integer where they are not).
    """
    n, d = vectors.shape
    by_id = np.argsort(ids, kind="stable")
    vectors, ids = vectors[by_id], ids[by_id]
    big = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1)
    kind = np.float64 if big < 2**53 else np.int64  # doubles hold every sum exactly below 2^53
    none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    v, q = vectors.astype(kind), queries.astype(kind)
    order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)  # each dimension's list, lowest value first
    ranked = np.ascontiguousarray(np.take_along_axis(v.T, order, axis=1))
    step = max(LEAST_DEPTH, n // DEPTH)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(q), np.int64)
    for row, x in enumerate(q):
        known = none if low is None or low[row] == np.iinfo(np.int64).min else kind(low[row])
        lists = np.flatnonzero(x)
        depth = np.zeros(len(lists), np.int64)
        at_depth = lambda depth, lists=lists, x=x: x[lists] * ranked[lists, np.where(x[lists] > 0, n - 1 - depth, depth)]
        given = at_depth(depth) if n else np.empty(0, kind)
        unseen = np.ones(n, bool)
        best_at, best = np.empty(0, np.int64), np.empty(0, kind)
        first = True
        while unseen.any():
            if len(lists) and (not first or known != none):
                kth = best.min() if len(best) >= k else none
                if given.sum() < max(kth, known):
                    break
            first = False
            if len(lists):
                goes = np.argpartition(-given, max(0, len(lists) // PART - 1))[: max(1, len(lists) // PART)]
                deeper = np.minimum(n, depth[goes] + step)
                spans = [order[i, n - e : n - s] if x[i] > 0 else order[i, s:e] for i, s, e in zip(lists[goes], depth[goes], deeper, strict=True)]
                new = np.zeros(n, bool)
                new[np.concatenate(spans)] = True
                fresh = np.flatnonzero(new & unseen)
                depth[goes] = deeper
                if (deeper >= n).any():  # a list has been read to its end, and so every vector
                    fresh = np.flatnonzero(unseen)
                else:
                    given = at_depth(depth)
            else:
                fresh = np.flatnonzero(unseen)
            unseen[fresh] = False
            counts[row] += len(fresh)
            fresh = fresh[ids[fresh] != query_ids[row]]
            scores = v[fresh] @ x
            on = scores >= known
            best_at, best = np.concatenate([best_at, fresh[on]]), np.concatenate([best, scores[on]])
            if len(best) > k:
                pick = np.lexsort((best_at, -best if kind is np.float64 else -1 - best))[:k]
                best_at, best = best_at[pick], best[pick]
        found.append((np.full(len(best), row), ids[best_at], best))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), counts
    a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, c.astype(np.int64), counts


def _cell(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows["asks"].to_numpy()
        names = ["query_id", "vec_id", "score", "scored"]
        if asked.all() or not asked.any():
            return pd.DataFrame({n: pd.array([], "Int64") for n in names})
        x = np.stack(rows["x"].to_numpy())
        ids, low = rows["id"].to_numpy(), rows["low"].to_numpy()[asked]
        a, b, c, counts = cell_top(x[asked], ids[asked], x[~asked], ids[~asked], k, low)
        # a row for each query with what it has scored, then its best
        nothing = pd.array([None] * len(counts), "Int64")
        scored = pd.DataFrame({"query_id": ids[asked], "vec_id": nothing, "score": nothing, "scored": counts})
        best = pd.DataFrame({"query_id": ids[asked][a], "vec_id": pd.array(b, "Int64"), "score": pd.array(c, "Int64"), "scored": np.zeros(len(a), np.int64)})
        return pd.concat([scored, best])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best vectors, all if there are fewer; and `scored`.

    Both have (id, x), x being whole numbers whose products' sums fit a long. A vector with a query's id is no
    candidate for it; ties go to smaller ids; vectors of another length than the query's are no candidates.
    Each row counts: an id with several vectors is as many candidates, and rows that repeat id and vector are
    too. As a query, such an id gets the k best rows of all its different vectors together. Empty vectors score 0.
    scored: the candidates whose scores were computed, out of all, over all cells.
    """
    vectors = vectors.withColumn("n", F.size("x"))
    queries = queries.dropDuplicates(["id", "x"]).withColumn("n", F.size("x"))
    blocks = max(1, -(-vectors.count() // VECTORS))
    asking = max(1, -(-queries.count() // QUERIES))
    none = F.lit(-(2**63)).cast("long")
    rows = vectors.withColumn("row", F.monotonically_increasing_id())  # repeats of a row are dealt apart
    dealt = lambda c, *by: F.pmod(F.xxhash64(*by), F.lit(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    left = rows.select(dealt(blocks, "row").alias("block"), spread(asking).alias("asking"), "n", F.lit(False).alias("asks"), "id", "x", none.alias("low"))
    left = written(left, "vectors")
    asked = queries.select(dealt(asking, "id", "x").alias("asking"), dealt(blocks, "x", "id").alias("own"), "n", F.lit(True).alias("asks"), "id", "x")
    schema = "query_id long, vec_id long, score long, scored long"
    searched = lambda right: left.unionByName(right).groupBy("block", "asking", "n").applyInPandas(_cell(k), schema)
    first = written(searched(asked.select(F.col("own").alias("block"), "asking", "n", "asks", "id", "x", none.alias("low"))), "first")
    # the kth score that a query has found already; of queries with several vectors none is known
    known = first.filter("vec_id is not null").groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("have"))
    several = queries.groupBy("id").agg(F.count(F.lit(1)).alias("vectors"))
    known = known.join(several, known["query_id"] == several["id"]).filter((F.col("have") == k) & (F.col("vectors") == 1)).select("query_id", "low")
    others = asked.join(known, asked["id"] == known["query_id"], "left").withColumn("block", spread(blocks)).filter("block <> own")
    found = first.unionByName(searched(others.select("block", "asking", "n", "asks", "id", "x", F.coalesce("low", none).alias("low"))))
    pair = F.struct((-F.col("score")).alias("s"), "vec_id")
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("vec_id").isNotNull(), pair))), 1, k)
    # each cell gave k rows a query at most; two levels keep a query's rows in one task few
    parts = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(best.alias("best"), F.sum("scored").alias("scored"))
    tops = parts.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"), F.sum("scored").alias("scored"))
    return tops.select("query_id", F.posexplode("best").alias("rank", "b"), "scored").select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"), "scored")


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k() of the rows whose vec_id is divisible by `every`, against all rows of (vec_id, embedding).

    Null vectors, those with null or non-finite components, and null ids take no part; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    x = written(quantised(vectors.select("vec_id", "embedding")), "quantised")
    return top_k(x, x.filter(F.col("id") % every == 0), k)
