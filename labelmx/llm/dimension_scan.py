"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

Vectors are scaled to length 1 and turned by one random rotation, so any first
part of their columns estimates a whole distance. k-means on a bounded sample
gives lists; every vector goes to its nearest one. A query reads the lists
nearest to it. Inside a list, columns are read in blocks: after each block the
partial squared distance is scaled up, and a candidate whose estimate lies above
the query's current k-th distance by more than the test allows is abandoned, and
so is one that is whole but beyond the k nearest of what was read with it. The
survivors' cosines are computed in double precision on the original vectors.

Equal vectors cannot all be among the k nearest, so only the k+1 smallest ids of
each distinct vector are searched (exact). Large lists are cut into blocks of
bounded size and queries of a list into groups, so no task holds a whole list.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most, take no part; rows with equal ids count once
(the vector with the smallest hash); a query with fewer candidates than k gets
all of those probed; ties go to the smaller id; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import column

SAMPLE_NUMBERS = 1_000_000  # training vectors times dimensions that reach the driver
MAX_LISTS = 2_048
BLOCK_ROWS = 4_096
QUERY_ROWS = 512
COLUMN_BLOCK = 16
EPSILON = 2.1
DENSE = 0.1  # share of a block's pairs from which on all are computed


class Index(NamedTuple):
    lists: DataFrame  # (list, id, vector, turned)
    rotation: np.ndarray
    centres: np.ndarray


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, vector)`` of the rows that take part, as doubles."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    found = rows.select(column(id_col).cast("bigint").alias("id"), column(vector).cast("array<double>").alias("vector"))
    found = found.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    found = found.withColumn("size", F.size("vector"))
    common = found.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    found = found.where(F.col("size") == (common["size"] if common else 0)).drop("size")
    first = Window.partitionBy("id").orderBy("hash")
    return found.withColumn("hash", F.xxhash64("vector")).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "hash")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centres(sample: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = _unit(np.where(np.abs(total).max(axis=1, keepdims=True) > 0, total, sample[:1]))
    return c


def _assign(rotation, centres, probes, batches):
    dim = len(rotation)
    for b in batches:
        if not b.num_rows:
            continue
        x = _unit(_matrix(b.column(1), dim))
        near = x @ centres.T
        if probes == 1:
            lists = np.argmax(near, axis=1)[:, None]
        else:
            lists = np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes]
        at = np.repeat(np.arange(len(x)), lists.shape[1])
        turned = x @ rotation
        ends = np.arange(len(at) + 1, dtype=np.int32) * dim
        wide = lambda m: pa.ListArray.from_arrays(pa.array(ends), pa.array(m[at].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), wide(_matrix(b.column(1), dim)), wide(turned)], ["list", "id", "vector", "turned"]
        )


_LISTED = "list int, id bigint, vector array<double>, turned array<double>"


def build_index(vectors: DataFrame, *, k: int = 5, seed: int = 7) -> Index | None:
    """Lists over all ``vectors(id, vector)``; the rotation is random, the centres fit a bounded sample."""
    n = vectors.count()
    if not n:
        return None
    dim = vectors.select(F.size("vector")).first()[0]
    most = max(64, SAMPLE_NUMBERS // dim)
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).select("vector").toArrow()
    sample = _unit(_matrix(sample.column(0), dim))
    centres = _centres(sample, max(1, min(MAX_LISTS, math.isqrt(n), len(sample) // 8)), seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    # more than k + 1 copies of one vector are never needed
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    few = vectors.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    few = few.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vector")
    lists = few.mapInArrow(partial(_assign, rotation, centres, 1), _LISTED)
    return Index(stored(lists, "lists"), rotation, centres)


def scan(queries: np.ndarray, query_ids: np.ndarray, turned: np.ndarray, ids: np.ndarray, k: int, epsilon: float = EPSILON, block: int = COLUMN_BLOCK):
    """Pairs (query, candidate) that survive the adaptive scan of one list, by row numbers."""
    dim = turned.shape[1]
    radius = np.full((len(queries), k), np.inf)
    kept_q, kept_c = [], []
    step = max(k, 256)
    for s in range(0, len(turned), step):
        part = turned[s : s + step]
        limit = radius[:, -1]
        cut = min(block, dim)
        d = (queries[:, :cut] ** 2).sum(axis=1)[:, None] + (part[:, :cut] ** 2).sum(axis=1)[None] - 2 * queries[:, :cut] @ part[:, :cut].T
        factor = lambda c: (c / dim) * (1 + epsilon / math.sqrt(c)) ** 2 if c < dim else 1.0
        slack = 1e-9
        alive = d <= limit[:, None] * factor(cut) + slack
        alive &= query_ids[:, None] != ids[None, s : s + step]
        # while many are left, a product of whole blocks costs less than picking rows
        while cut < dim and alive.mean() > DENSE:
            nxt = min(cut + block, dim)
            x, y = queries[:, cut:nxt], part[:, cut:nxt]
            d += (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
            cut = nxt
            alive &= d <= limit[:, None] * factor(cut) + slack
        if cut == dim and d.shape[1] > k:
            alive &= d <= np.partition(np.where(alive, d, np.inf), k - 1, axis=1)[:, k - 1 : k] + slack
        q, c = np.nonzero(alive)
        d = d[q, c]
        while cut < dim and len(q):
            nxt = min(cut + block, dim)
            d = d + ((queries[q, cut:nxt] - part[c, cut:nxt]) ** 2).sum(axis=1)
            cut = nxt
            stay = d <= limit[q] * factor(cut) + slack
            q, c, d = q[stay], c[stay], d[stay]
        if len(q):
            order = np.lexsort((d, q))
            q, c, d = q[order], c[order], d[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            first = rank < k
            fresh = np.full((len(queries), k), np.inf)
            fresh[q[first], rank[first]] = d[first]
            radius = np.sort(np.concatenate([radius, fresh], axis=1), axis=1)[:, :k]
            near = d <= radius[q, -1] + slack
            kept_q.append(q[near])
            kept_c.append(c[near] + s)
    if not kept_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(kept_q), np.concatenate(kept_c)


def _search(dim, k, left: pa.Table, right: pa.Table) -> pa.Table:
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not left.num_rows or not right.num_rows:
        return empty
    ids, qids = left.column("id").to_numpy(), right.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    turned, vectors, ids = _matrix(left.column("turned"), dim)[order], _matrix(left.column("vector"), dim)[order], ids[order]
    q, c = scan(_matrix(right.column("turned"), dim), qids, turned, ids, k)
    if not len(q):
        return empty
    a, b = _matrix(right.column("vector"), dim)[q], vectors[c]
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    score = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
    best = np.lexsort((ids[c], -score, q))
    q, c, score = q[best], c[best], score[best]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.table({"query_id": qids[q[first]], "vec_id": ids[c[first]], "score": score[first]})


def nearest(index: Index | None, vectors: DataFrame, queries: DataFrame, *, k: int = 5, probes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each of ``queries(id, vector)``.

    ``probes`` is the number of lists read per query, two thirds of them unless given.
    """
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n_lists = len(index.rotation), len(index.centres)
    probes = min(n_lists, max(1, probes or -(-2 * n_lists // 3)))
    asked = queries.mapInArrow(partial(_assign, index.rotation, index.centres, probes), _LISTED)
    asked = stored(asked, "asked")
    # both sides of a list are cut into groups of bounded size; their numbers travel with the rows
    sizes = index.lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("groups"))
    both = F.broadcast(sizes.join(groups, "list"))  # at most MAX_LISTS rows
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    group = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.lists.join(both, "list").select("list", block.alias("block"), every("groups").alias("group"), "id", "vector", "turned")
    right = asked.join(both, "list").select("list", every("blocks").alias("block"), group.alias("group"), "id", "vector", "turned")
    keys = ["list", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(_search, dim, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries, *, k: int = 5, probes: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Index all valid rows and search those for which ``queries`` (a condition on ``id``) holds."""
    vectors = stored(valid_vectors(rows, id_col, vector), "vectors")
    return nearest(build_index(vectors, k=k), vectors, vectors.where(queries), k=k, probes=probes)
