"""Exact vector search of a query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _top(batches: Iterator[pd.DataFrame], ids: np.ndarray, queries: np.ndarray, k: int, tags: list[set] | None = None) -> Iterator[pd.DataFrame]:
    """The k best rows of each query in one partition; ties by the smaller id. With tags, only rows that share one with the query."""
    best_s = np.full((len(ids), 0), 0.0)
    best_i = np.zeros((len(ids), 0), np.int64)
    for pdf in batches:
        rows = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(rows, axis=1)
        scores = queries @ (rows / np.where(norms > 0, norms, 1)[:, None]).T
        if tags is not None:
            own = [set(t) if t is not None else set() for t in pdf["tags"]]
            scores[~np.array([[not t.isdisjoint(q) for t in own] for q in tags])] = -np.inf
        s = np.concatenate([best_s, scores], axis=1)
        i = np.concatenate([best_i, np.broadcast_to(pdf["id"].to_numpy(), scores.shape)], axis=1)
        order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    width = best_s.shape[1]
    out = pd.DataFrame({"query_id": np.repeat(ids, width), "id": best_i.ravel(), "similarity": best_s.ravel()})
    yield out[out["similarity"] > -np.inf]


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest rows by cosine for each query; both have id and vector.

    Queries are taken in blocks of BLOCK to the tasks (1 MB for 64 numbers), every row meets every query in a matrix
    product, and k rows per query leave a task. Null vectors and vectors of other lengths are no rows; a
    zero vector has similarity 0 to all; ties go to the smaller id. If both have tags (arrays), a row counts for a query only if they
    share one.
    """
    spark = rows.sparkSession
    more = ["tags"] if "tags" in rows.columns and "tags" in queries.columns else []
    asked = queries.where("id is not null and vector is not null").select("id", "vector", *more)
    n = int(asked.count() // BLOCK) + 1
    parts = []
    for b in range(n):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toPandas().drop_duplicates("id")
        if block.empty:
            continue
        q = np.stack(block["vector"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(q, axis=1)
        tags = [set(t) if t is not None else set() for t in block["tags"]] if more else None
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), q / np.where(norms > 0, norms, 1)[:, None], k, tags))
        usable = rows.select("id", "vector", *more).where((F.size("vector") == q.shape[1]) & F.col("id").isNotNull())
        parts.append(usable.mapInPandas(lambda it, shared=shared: _top(it, *shared.value), "query_id long, id long, similarity double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
