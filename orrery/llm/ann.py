"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is centred, rotated at random and kept as the signs of its components, packed to bits,
with two scalars: its distance from the centre and the inner product of its direction with its code.
A query is rotated too and cut into bit planes, so its inner product with a code is a sum of counts of
common bits. These estimate the distances, and the scalars bound the error. Only vectors whose lower
bound comes under the k-th best distance found so far are compared by their original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize

#: Queries that one pass over the codes answers; they are all that is sent to the executors.
QUERY_BLOCK = 2048
#: Width of the error bound in standard deviations of the estimate.
SIGMAS = 4.0
#: Rows of the index compared at once.
ROW_BLOCK = 4096
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 17
#: Bits of a query's component; what is lost by them is part of the error bound.
QUERY_BITS = 6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that are null, empty, zero, or hold null, or
    non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull()).filter(ok)
    return rows


def dimension(rows: DataFrame) -> int:
    top = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return top["dim"] if top else 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def packed(signs: np.ndarray) -> np.ndarray:
    """(rows, components) of bits as (rows, 64-bit words)."""
    n, dim = signs.shape
    out = np.zeros((n, -(-dim // 64) * 8), np.uint8)
    out[:, : -(-dim // 8)] = np.packbits(signs, axis=1)
    return out.view(np.uint64)


def index(rows: DataFrame, dim: int, centre: np.ndarray, single: bool, seed: int = 7) -> DataFrame:
    """(vec_id, v, code, norm, dot): the codes of all vectors and their correction scalars. single: the
    components are single precision, and v keeps them so."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for b in batches:
            own = _matrix(b["v"], dim)
            x = (own - centre) @ turn.T
            norm = np.sqrt((x * x).sum(1))
            # <direction, code>, the code being the corner of the unit cube's inscribed ball
            dot = np.abs(x).sum(1) / np.where(norm > 0, norm, 1) / np.sqrt(dim)
            code = pa.array([c.tobytes() for c in packed(x >= 0)], pa.binary())
            v = pa.array([c.tobytes() for c in own.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], v, code, pa.array(norm), pa.array(np.where(norm > 0, dot, 1.0))], names=["vec_id", "v", "code", "norm", "dot"])

    return rows.mapInArrow(run, "vec_id long, v binary, code binary, norm double, dot double")


class Planes:
    """Rotated queries, their components in QUERY_BITS bits each: low + step * number. planes: for each bit
    and word of the codes the bits of all queries."""

    def __init__(self, turned: np.ndarray):
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        number = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = number.sum(1)
        self.dim = turned.shape[1]
        # what rounding can change in the inner product with any code
        self.slack = np.abs(self.low[:, None] + self.step[:, None] * number - turned).sum(1) / np.sqrt(self.dim)
        self.planes = np.stack([packed((number >> j) & 1 > 0) for j in range(QUERY_BITS)])

    def products(self, lo: int, hi: int, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """(queries lo to hi, codes): inner products with the codes, whose components are +-1 / sqrt(dim).
        ones: the bits that are set in each code."""
        counts = np.zeros((hi - lo, len(codes)), np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                counts += np.bitwise_count(plane[lo:hi, w, None] & codes[None, :, w]).astype(np.int32) << j
        # sum of +-q = 2 * (sum of q where the bit is set) - sum of q
        set_ = self.step[lo:hi, None] * counts + self.low[lo:hi, None] * ones[None, :]
        whole = self.step[lo:hi] * self.total[lo:hi] + self.low[lo:hi] * self.dim
        return (2 * set_ - whole[:, None]) / np.sqrt(self.dim)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, component by component in order."""
    x = x.astype(np.float64)
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = q[:, j] - x[:, j]
        total += d * d
    return np.sqrt(total)


def search_block(codes: DataFrame, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int, single: bool, sigmas: float = SIGMAS, seed: int = 7) -> DataFrame:
    """The k best of each partition of the index for each query: query_id, vec_id, score."""
    dim, kind = queries.shape[1], np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = (queries - centre) @ rotation(dim, seed).T
        q_norm = np.sqrt((turned * turned).sum(1))
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        planes = Planes(turned)
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                b = whole.slice(at, ROW_BLOCK)
                vec = b["vec_id"].to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(b["v"].to_pylist()), kind).reshape(-1, dim)
                norm, dot = b["norm"].to_numpy(), b["dot"].to_numpy()
                bits = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint64).reshape(len(vec), -1)
                ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
                # <q, direction> is about <q, code> / dot; the part of the code across the direction gives the error
                error = sigmas * np.sqrt(np.maximum(1 - dot * dot, 0)) / np.sqrt(max(dim - 1, 1))
                for lo in range(0, len(ids), QUERIES_AT_ONCE):
                    hi = min(lo + QUERIES_AT_ONCE, len(ids))
                    near = planes.products(lo, hi, bits, ones) + planes.slack[lo:hi, None] + q_norm[lo:hi, None] * error[None, :]
                    low = (norm * norm)[None, :] - 2 * near * (norm / dot)[None, :]  # less |query|^2
                    part = slice(lo, lo + len(low))
                    m = min(k + 1, len(vec))
                    if not np.isfinite(best_d[part, -1]).all():
                        # nothing to hold against yet: the most promising first
                        first = np.argpartition(low, m - 1, axis=1)[:, :m]
                        _improve(best_d, best_i, queries, ids, np.repeat(np.arange(lo, lo + len(low)), m), x, vec, first.ravel(), k)
                        np.put_along_axis(low, first, np.inf, axis=1)
                    limit = best_d[part, -1] ** 2 - q_norm[part] ** 2
                    near = low <= (limit + 1e-4 * (1 + q_norm[part] ** 2))[:, None]
                    qi, xi = np.nonzero(near & np.isfinite(low))
                    for s in range(0, len(qi), PAIRS_AT_ONCE):
                        _improve(best_d, best_i, queries, ids, lo + qi[s : s + PAIRS_AT_ONCE], x, vec, xi[s : s + PAIRS_AT_ONCE], k)
        qi, ki = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(best_i[qi, ki]), pa.array(best_d[qi, ki])], names=["query_id", "vec_id", "score"])

    return codes.select("vec_id", "v", "code", "norm", "dot").mapInArrow(run, "query_id long, vec_id long, score double")


def _improve(best_d: np.ndarray, best_i: np.ndarray, queries: np.ndarray, ids: np.ndarray, qi: np.ndarray, x: np.ndarray, vec: np.ndarray, xi: np.ndarray, k: int) -> None:
    """Compare pairs by their original components; qi is sorted."""
    d = queries[qi] - x[xi]  # in double precision, as the queries are
    near = np.einsum("ij,ij->i", d, d) <= best_d[qi, -1] ** 2 * (1 + 1e-9)
    near &= ids[qi] != vec[xi]
    qi, xi = qi[near], xi[near]
    if len(qi):
        _merge(best_d, best_i, qi, distances(queries[qi], x[xi]), vec[xi], k)


def _merge(best_d: np.ndarray, best_i: np.ndarray, qi: np.ndarray, d: np.ndarray, vec: np.ndarray, k: int) -> None:
    """Put the distances found into the k best, smaller vec_id first where they tie."""
    order = np.lexsort((vec, d, qi))
    qi, d, vec = qi[order], d[order], vec[order]
    starts = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]]))
    for s, e in zip(starts, np.append(starts[1:], len(qi)), strict=True):
        row, e = qi[s], min(e, s + k)
        dd, ii = np.concatenate([best_d[row], d[s:e]]), np.concatenate([best_i[row], vec[s:e]])
        top = np.lexsort((ii, dd))[:k]
        best_d[row], best_i[row] = dd[top], ii[top]


def nearest(vectors: DataFrame, query_ids, k: int = 10, sigmas: float = SIGMAS, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """The k nearest vectors of each query vector, by Euclidean distance in double precision.

    vectors has vec_id and embedding; query_ids is a condition on vec_id that picks the queries. A row is
    no candidate for its own vec_id. Out come query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components, or are of
    another length than most, take no part. Rows that repeat a vec_id are candidates one by one; as a
    query the least of their vectors counts. An empty table gives an empty result.

    Queries go to the executors in blocks of about query_block vectors, whatever their number, and each
    block passes over all codes once.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    if not (dim := dimension(rows)):
        return empty
    rows = rows.filter(F.size("v") == dim)
    means = rows.agg(*(F.avg(F.col("v")[j]) for j in range(dim))).first()
    centre = np.array([float(m) for m in means])
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    codes = materialize(index(rows, dim, centre, single, seed), "ann-index")
    asked = materialize(rows.filter(query_ids).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    blocks = max(1, -(-asked.count() // query_block))
    found = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        if part.num_rows:
            q = _matrix(part["v"].combine_chunks(), dim)
            best = search_block(codes, part["vec_id"].to_numpy(), q, centre, k, single, sigmas, seed)
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
            best = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            # each block's answers are written, so the driver holds the queries of one block at a time
            found.append(materialize(best, "ann-found").inputFiles() if blocks > 1 else best)
    if not found:
        return empty
    if blocks == 1:
        return found[0]
    return spark.read.schema(empty.schema).parquet(*(f for files in found for f in files))
