"""Nearest neighbours by randomly rotated one-bit codes with error bounds, reranked exactly.

Index. Every vector is scaled to length 1 and rotated by a seeded random rotation; the signs
of its coordinates are its code (packed bits), and the inner product f of the rotated vector
with its code, as a unit vector, is its correction scalar. For a unit query q, <code, Rq> / f
estimates the cosine, and with very high probability the error is at most
SIGMAS * sqrt(1 - f*f) / f / sqrt(D - 1).

Search. The index is dealt into shares of bounded size and stands still: a chunk of it moves once.
Queries, one in fifty vectors or fewer, are copied to every share in blocks. Both go through one
exchange by share, not through a join: a join's size estimate does not see the copies, and as a
broadcast all of them would pass the driver. A task holds one share of the index, and the blocks
stream past it. In a chunk, the vectors with the best estimates are scored exactly; their k-th
best score then bars every vector whose estimate plus bound is below it, and the rest are scored
exactly, in double precision, on the original vectors. A share gives its k best of each query, so
what is merged in the end is k rows a query and share. Original vectors lie beside the codes: at a
few dozen dimensions the bounds are wide, and a join of what passes them would move more than the
vectors.

Vectors are first divided by the power of two of their largest component, which is exact, so that
neither products nor norms leave the range of doubles.

Defined cases: vectors null, zero, or holding null or non-finite components take no part, and
neither do rows with a null vec_id; a query meets the vectors of its own length only; equal
scores go to the smaller vec_id; fewer than k candidates give fewer rows; rows that share a vec_id are
candidates each, but never of a query with that id; equal rows (vec_id and vector) are one query,
with k rows at most, and rows of one vec_id with different vectors a query each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stored, table

SIGMAS, CHUNK, QUERIES, SEED = 4.0, 4096, 1024, 7
#: Bytes of vectors that a share of the index has, about; a task holds one share. Pairs scored at a time.
SHARE, PAIRS = 128 << 20, 1 << 13


@functools.cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists(v, odd) & F.exists(v, lambda x: x != 0))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of vectors, for each length: the places, and the vectors divided by the power of two of their largest component."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        v = column.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
        yield at, np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(in_order(v, v))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed coordinate by coordinate, so that equal rows give equal sums."""
    total = np.zeros(max(len(a), len(b)))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            ids = part.column(0).to_numpy()
            for at, v in _by_length(part.column(1)):
                dim = v.shape[1]
                turned = v @ rotation(dim).T
                turned /= np.linalg.norm(turned, axis=1, keepdims=True)
                f = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((dim, pa.int32()), (ids[at].tobytes(), pa.binary()), (v.tobytes(), pa.binary()), (np.packbits(turned > 0, axis=1).tobytes(), pa.binary()), (f.tobytes(), pa.binary()))],
                    names=["dim", "ids", "vectors", "codes", "f"],
                )


def build_index(vectors: DataFrame) -> DataFrame:
    """Chunks of the index: ids, vectors, packed codes and correction scalars of up to CHUNK vectors of one length a row."""
    return vectors.mapInArrow(_coded, "dim int, ids binary, vectors binary, codes binary, f binary")


def _blocked(key, part):
    part = part.combine_chunks()
    ids, keys, column = (part.column(c).chunk(0) for c in ("id", "key", "v"))
    rows = [(len(v[0]), ids.to_numpy()[at].tobytes(), keys.to_numpy()[at].tobytes(), v.tobytes()) for at, v in _by_length(column)]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("dim", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("vectors", pa.binary())))})


def held_chunk(ids: np.ndarray, v: np.ndarray, codes: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """A chunk as a search reads it: ids, codes and correction scalars, the bounds, and the vectors by coordinate with their norms."""
    bound = SIGMAS * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(v.shape[1] - 1, 1)) + 1e-4
    return ids, codes, f.astype(np.float32), bound.astype(np.float32), np.ascontiguousarray(v.T), _norms(v)


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, in order, and their ranks from 0."""
    at = np.lexsort((ids, -scores, of))
    of = of[at]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    top = rank < k
    return of[top], ids[at][top], scores[at][top], rank[top]


def search_chunks(q_ids: np.ndarray, q: np.ndarray, chunks: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, score) of the k best of the chunks for each query.

    A query's bar is the k-th best score that it has met: what cannot reach it is not scored.
    """
    dim, least = q.shape[1], np.finfo(np.float32).min
    near_q, slack = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), 1e-6 * (dim + 8)
    unit = (near_q @ rotation(dim).T).astype(np.float32)
    by_coordinate, q_norm = np.ascontiguousarray(q.T), _norms(q)
    bars = np.full(len(q), least, np.float64)
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def scored(of, at, vt, v_norm):
        out = np.empty(len(of))
        for i in range(0, len(of), PAIRS):
            a, b = of[i : i + PAIRS], at[i : i + PAIRS]
            total = np.zeros(len(a))
            for x, y in zip(by_coordinate, vt, strict=True):  # as in_order sums
                total += y[b] * x[a]
            out[i : i + PAIRS] = total / (v_norm[b] * q_norm[a])
        return out

    def reaching(of, at, near_v):
        """Which of the pairs reach their bar by single precision, within its error."""
        out = np.empty(len(of), bool)
        for i in range(0, len(of), PAIRS):
            a, b = of[i : i + PAIRS], at[i : i + PAIRS]
            out[i : i + PAIRS] = np.einsum("ij,ij->i", near_q.take(a, axis=0), near_v.take(b, axis=0)) + slack >= bars[a]
        return out

    def raise_bars(of, scores, rank):
        full = rank == k - 1
        bars[of[full]] = np.maximum(bars[of[full]], scores[full])

    for ids, codes, f, bound, vt, v_norm in chunks:
        signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / (f * np.float32(np.sqrt(dim)))[:, None]
        upper = unit @ signs.T + bound
        own = np.flatnonzero(np.isin(ids, q_ids))
        upper[:, own] = np.where(q_ids[:, None] == ids[own], -np.inf, upper[:, own])
        if len(new := np.flatnonzero(bars == least)):
            n = min(4 * k, len(ids))
            at = np.argpartition(-upper[new], n - 1, axis=1)[:, :n].ravel()
            of = np.repeat(new, n)
            other = upper[of, at] >= least
            of, at = of[other], at[other]
            of, _, scores, rank = _best(of, ids[at], scored(of, at, vt, v_norm), k)
            raise_bars(of, scores, rank)
        of, at = np.nonzero(upper >= bars.astype(np.float32)[:, None])
        close = reaching(of, at, (vt / v_norm).T.astype(np.float32, order="C"))
        of, at = of[close], at[close]
        scores = scored(of, at, vt, v_norm)
        near = scores >= bars[of]
        *best, rank = _best(*(np.concatenate(x) for x in zip(best, (of[near], ids[at[near]], scores[near]), strict=True)), k)
        raise_bars(best[0], best[2], rank)
    return tuple(best)


def _search(k: int):
    """Of rows sorted by share, in each share chunks of the index before blocks of queries: the k best of the share for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held = None, defaultdict(list)
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                if r["share"] != share:
                    share, held = r["share"], defaultdict(list)
                ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
                if r["asks"]:
                    of, near, scores = search_chunks(ids, v, held[r["dim"]], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[of], np.frombuffer(r["keys"], np.int64)[of], near, scores)], names=["query_id", "query", "vec_id", "score"])
                else:
                    held[r["dim"]].append(held_chunk(ids, v, np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["f"], np.float64)))

    return run


def shares_for(n: int, size: int, partitions: int) -> int:
    """The number of shares of ``n`` vectors of ``size`` bytes in all: one a partition, but none without a chunk and none above SHARE."""
    return max(1, -(-size // SHARE), min(partitions, -(-n // CHUNK)))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which ``queries`` (on ``id``) holds."""
    use = usable(vectors, vec_id, embedding)
    asked = stored(use.where(queries).distinct().withColumn("key", F.monotonically_increasing_id()))
    n_blocks = max(1, -(-asked.count() // QUERIES))
    n, size = use.agg(F.count("id"), F.coalesce(F.sum(F.size("v") * F.lit(8).cast("long")), F.lit(0))).first()
    shares = shares_for(n, size, shuffle_partitions(vectors.sparkSession))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).groupBy("block").applyInArrow(_blocked, "dim int, ids binary, keys binary, vectors binary")
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(True).alias("asks"), "*")
    chunks = build_index(use).select(F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int").alias("share"), F.lit(False).alias("asks"), "*")
    dealt = chunks.unionByName(copies, allowMissingColumns=True).repartition("share").sortWithinPartitions("share", "asks")
    found = dealt.mapInArrow(_search(k), "query_id long, query long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_rotated_codes(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, x: a + x)) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])), lambda a, x: a + x) / (c.n * q.n) AS score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
