"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash of their id; a block sorts its components into one list per dimension.
For each query the lists are read from the end that its sign favours, a few rows deeper each round; what the rounds
reveal is scored exactly, and the sum of the query's components times the values at the current depth bounds all the
rest. A block is done when this bound is below its kth score, so ties are never cut. The best of each block meet
in a small per-query ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.llm.common import prepare, table
from culvert.session import materialise

K, QUERY_STEP, SCALE = 5, 50, 256
#: candidates in a block and queries that meet it in one task: 64 components of both take about 10 MB
BLOCK, QUERIES = 16_384, 2_048
FIRST_DEPTH = 16
FOUND = "query_id long, vec_id long, score long"


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best in the block by (score, -vec_id), its own id left out."""
    n = len(ids)
    # sums below 2**53 are exact in doubles, whose products are faster
    top = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if top < 2**53 else object if top >= 2**63 else np.int64
    x = vectors.astype(kind)
    lists = np.argsort(vectors, axis=0, kind="stable")  # of each dimension, from the least value
    out_q, out_v, out_s = [], [], []
    for qid, q in zip(query_ids.tolist(), queries.astype(kind), strict=True):
        used = np.flatnonzero(q != 0)
        down = q[used] > 0
        seen = ids == qid
        best_v, best_s = np.empty(0, np.int64), np.empty(0, kind)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            upto = min(n, depth + step)
            if len(used):
                rows = np.concatenate((lists[n - upto : n - depth, used[down]].ravel(), lists[depth:upto, used[~down]].ravel()))
                fresh = np.zeros(n, bool)
                fresh[rows] = True
                fresh = np.flatnonzero(fresh & ~seen)
            else:  # a zero query scores zero everywhere: the list of ids decides
                fresh = np.flatnonzero(~seen)
                upto = n
            seen[fresh] = True
            score = x[fresh] @ q
            best_v, best_s = np.append(best_v, ids[fresh]), np.append(best_s, score)
            order = np.lexsort((best_v, -best_s))[:k]
            best_v, best_s = best_v[order], best_s[order]
            depth, step = upto, step * 2
            if len(best_s) == k and depth < n:
                edge = np.where(down, x[lists[n - depth, used], used], x[lists[depth - 1, used], used])
                if edge @ q[used] < best_s[-1]:
                    break
        out_q.append(np.full(len(best_v), qid))
        out_v.append(best_v)
        out_s.append(best_s.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (id, v) the k best of ``vectors`` (id, v) with another id.

    Vectors are lists of whole numbers, all of one length with the query; other lengths never meet. Ties go to the
    smaller id; fewer than k candidates are all returned.
    """
    count, asked = vectors.count(), queries.count()
    blocks, groups = max(1, math.ceil(count / BLOCK)), max(1, math.ceil(asked / QUERIES))
    key = F.struct(F.col("block"), F.col("part"), F.size("v").alias("dims"))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    left = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), to_all).select("id", "v", key.alias("key"))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    right = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part"), to_all).select("id", "v", key.alias("key"))
    prepare(vectors.sparkSession)

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        found = search_block(candidates.column("id").to_numpy(), _matrix(candidates.column("v")), asked.column("id").to_numpy(), _matrix(asked.column("v")), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    met = left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(search, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v: components as floor(scale * x). Rows with a null id, no vector, or null or non-finite components go.

    Exact repeats of a row leave one; further columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return rows.distinct()


def search_every(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """The k best of every row whose id is divisible by ``query_step``, against all rows.

    Several vectors under one id are all candidates; as a query the id has the least of them. An empty table gives
    an empty result.
    """
    rows = materialise(quantised(vectors, id_col, vector_col), "vectors")
    asked = rows.filter(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("v"))
    return top_k(rows, asked, k)


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_every(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
