"""Exact top-k search by integer inner product.

Vectors are packed into tiles. Query tiles and shard tiles meet on a grid: a query tile goes to every column
of its row and a shard tile to every row of its column, so that each pair meets in one task and a task
holds a few tiles of either kind, whatever the sizes of the tables. A task multiplies tile by tile, keeps
the best k per query and tile, and merges the lists as a tree; the lists of all columns are merged by a
window whose partial limit works before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, stored, table

QUERY_ROWS, SHARD_ROWS, TILE_BYTES = 512, 4096, 4 << 20
#: Tiles of either kind in a cell of the grid, on average.
QUERY_TILES, SHARD_TILES = 4, 8


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Tiles of vectors (id long, v array): dim, ids and floor(256 x) per component, in the narrowest type.

    Null vectors, vectors with a null or non-finite component and rows with a null id are left out.
    """

    def run(b):
        ids, col = b.column(0), b.column(1)
        ok = np.flatnonzero(~(ids.is_null().to_numpy(False) | col.is_null().to_numpy(False)))
        ids, col = ids.take(pa.array(ok)), col.take(pa.array(ok))
        x = np.floor(256 * col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
        size = np.diff(np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(False).astype(np.int64))]))
        ends = np.cumsum(size)
        ids = ids.to_numpy(False).astype(np.int64)
        for dim in np.unique(size[size > 0]):
            mine = np.flatnonzero(size == dim)
            m = x[(ends[mine] - dim)[:, None] + np.arange(dim)]
            fine = np.isfinite(m).all(1)
            m, own = m[fine], ids[mine[fine]]
            step = max(1, min(rows, TILE_BYTES // (8 * int(dim))))
            for a in range(0, len(own), step):
                part = m[a : a + step]
                peak = np.abs(part).max()
                kind = "<i2" if peak < 2**15 else "<i4" if peak < 2**31 else "<f8"
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([own[a : a + step].tobytes()], pa.binary()), pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["dim", "ids", "kind", "m"])

    return map_arrow(vectors, run, "dim int, ids binary, kind string, m binary")


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; beyond the range of a long they are cut to it."""
    if not len(q) or not len(s):
        return np.zeros((len(q), len(s)), np.int64)
    if np.abs(q).max() * np.abs(s).max() * q.shape[1] < 2.0**53:
        return (q @ s.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in whole(q) @ whole(s).T], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores and their ids, ties to the smaller id, in order."""
    if len(score) > k:
        least = -np.partition(-score, k - 1)[k - 1]
        over, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
        if len(even) > k:
            even = even[np.argpartition(ids[even], k - 1)[:k]]
        at = np.concatenate([over, even])
        score, ids = score[at], ids[at]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search_cell(queries: list, shards: list, k: int) -> list[tuple[int, int, int]]:
    """Rows (query, id, score): the best k of each query over all shards of a cell; tiles are (ids, matrix)."""
    out = []
    for qid, q in queries:
        lists: list = [[] for _ in qid]
        for sid, s in shards:
            score = products(q, s)
            for i, one in enumerate(qid):
                other = sid != one
                row, ids = (score[i], sid) if other.all() else (score[i][other], sid[other])
                lists[i].append(best(row, ids, k))
        for one, parts in zip(qid, lists):
            while len(parts) > 1:  # a tree of merges
                parts = [best(np.concatenate([x[0] for x in parts[i : i + 2]]), np.concatenate([x[1] for x in parts[i : i + 2]]), k) for i in range(0, len(parts), 2)]
            for score, ids in parts:
                out += [(int(one), int(v), int(p)) for p, v in zip(score, ids)]
    return out


def top_k(queries: DataFrame, shards: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: for each query (id, v) the k rows of shards (id, v) of the highest score.

    A query meets no row of its own id, and only vectors of its length. A repeated query id counts once, with
    its least vector in whole numbers among those without null or non-finite components; repeated rows of shards count each. Queries without candidates return no row.
    """
    n = queries.count()
    scaled = F.transform("v", lambda x: x.cast("double") * 256)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    fine = F.coalesce(F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    queries = queries.where(F.col("id").isNotNull() & fine & (F.size("v") > 0)).groupBy("id").agg(F.min(F.struct(whole.alias("whole"), "v")).alias("least")).select("id", "least.v")
    q = stored(pack(queries.coalesce(max(1, math.ceil(n / QUERY_ROWS))), QUERY_ROWS).withColumn("tile", F.monotonically_increasing_id()), "topk-queries")
    s = stored(pack(shards, SHARD_ROWS).withColumn("tile", F.monotonically_increasing_id()), "topk-shards")
    down, across = max(1, math.ceil(q.count() / QUERY_TILES)), max(1, math.ceil(s.count() / SHARD_TILES))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = q.select("dim", "ids", "kind", "m", F.pmod(F.xxhash64("tile"), F.lit(down)).cast("int").alias("row"), every(across, "col"))
    s = s.select("dim", "ids", "kind", "m", F.pmod(F.xxhash64("tile"), F.lit(across)).cast("int").alias("col"), every(down, "row"))

    def tiles(pdf: pd.DataFrame) -> list:
        return [(np.frombuffer(i, np.int64), np.frombuffer(m, kind).reshape(-1, d).astype(np.float64)) for i, kind, m, d in zip(pdf["ids"], pdf["kind"], pdf["m"], pdf["dim"])]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(search_cell(tiles(left), tiles(right), k) if len(left) and len(right) else [], columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["row", "col", "dim"]
    found = q.groupBy(*key).cogroup(s.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every embedding whose vec_id is divisible by 50, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


#: floor(256 x) as whole numbers; a vector with a null or non-finite component takes no part.
OP4_SQL = """
WITH part AS (SELECT vec_id, row_number() OVER () AS r, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
     whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM part
               WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
     query AS (SELECT vec_id, min(v) AS v FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id),
     scored AS (SELECT q.vec_id AS query_id, s.vec_id, list_inner_product(q.v, s.v)::BIGINT AS score
                FROM query q JOIN whole s ON q.vec_id <> s.vec_id AND len(q.v) = len(s.v)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
