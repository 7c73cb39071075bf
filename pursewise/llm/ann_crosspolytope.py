"""Nearest neighbours by cross-polytope hashing (operator 1).

Largest inner product becomes nearest direction by one extra component: a vector x of norm
|x| <= M is indexed as (x / M, sqrt(1 - |x|^2 / M^2)), a query q as (q / |q|, 0). Rows are
split into ranges of norms (a factor of sqrt(2) each, so that short ones do not lean towards
the extra axis) with an M and tables of their own, and a query probes them all. A fast
Hadamard pseudo-rotation (three rounds of random signs and a Walsh-Hadamard transform) turns
the unit vectors, and a hash is the nearest signed axis; several such axes make the code of a
bucket, the last one over as many axes as give about one bucket for ROWS vectors. Each of
TABLES tables has its own rotations. A query probes in every table its own bucket and the
PROBES - 1 next likely ones.

Candidates are reranked exactly: inside the bucket's task the query meets the bucket's
vectors as a matrix product, and only its best are passed on, with the inner product of the
original vectors in double precision. Pairs are never emitted. Large buckets are cut into
blocks on both sides, and equal vectors are one candidate, so a vector that many rows share
costs as much as one. Queries that found fewer than k are run against all vectors in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursewise.llm.common import stored

TABLES, PROBES = 12, 24
#: Above so many vectors the probes grow with the root of their number, or recall would fall.
PROBED = 100_000
#: Vectors of an average bucket; rows of one block of a bucket, queries of one block.
ROWS, BLOCK, QUERIES = 256, 4096, 1024
#: Norm ranges that hold vectors, at most; the last one holds all that is shorter.
RANGES = 32
#: Pairs whose products are computed again at a time.
PAIRS = 50_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytopes:
    """The tables' hashes for vectors of ``dim`` components in about ``buckets`` buckets."""

    def __init__(self, dim: int, buckets: int, tables: int = TABLES, seed: int = 5):
        self.dim, self.tables = dim, tables
        self.size = 1 << max(1, math.ceil(math.log2(dim + 1)))
        full = 2 * self.size
        self.axes = []  # axes used by each hash of a code
        left = max(2, buckets)
        while left > full:
            self.axes.append(self.size)
            left = -(-left // full)
        self.axes.append(max(1, -(-left // 2)))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.signs = rng.choice([-1.0, 1.0], (tables, len(self.axes), 3, self.size))

    def rotated(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        padded = np.zeros((len(x), self.size))
        padded[:, :x.shape[1]] = x
        out = []
        for k, axes in enumerate(self.axes):
            y = padded
            for signs in self.signs[table, k]:
                y = _hadamard(y * signs)
            out.append(y[:, :axes])
        return out

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row: the nearest signed axis of each hash, as one number."""
        code = np.zeros(len(x), np.int64)
        for y in self.rotated(x, table):
            at = np.abs(y).argmax(axis=1)
            code = code * (2 * y.shape[1]) + 2 * at + (y[np.arange(len(y)), at] < 0)
        return code

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` likeliest buckets of each row (all there are, if fewer).

        A bucket costs the squared gaps between the best axis of each hash and the one it
        stands for; the cheapest combinations are kept hash by hash.
        """
        cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for y in self.rotated(x, table):
            signed = np.stack([y, -y], axis=2).reshape(len(y), -1)  # 2 * axis + (negative)
            gaps = (signed.max(axis=1, keepdims=True) - signed) ** 2
            take = min(count, gaps.shape[1])
            near = np.argsort(gaps, axis=1, kind="stable")[:, :take]
            cost = (cost[:, :, None] + np.take_along_axis(gaps, near, 1)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * gaps.shape[1] + near[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :count]
            cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
        return code


def _kind(rows: DataFrame) -> str:
    """How vectors are packed: floats as they are, everything else as doubles."""
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    return "<f4" if element == "float" else "<f8"


def _vectors(packed, dim: int, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles (exactly the original components)."""
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64)


def _lengths(x: np.ndarray) -> np.ndarray:
    """log2 of the rows' norms, by way of their largest components: no square over- or underflows."""
    most = np.abs(x).max(axis=1)
    return np.log2(most) + 0.5 * np.log2(((x / most[:, None]) ** 2).sum(axis=1))


def _scaled(x: np.ndarray, log_length) -> np.ndarray:
    """``x / 2 ** log_length``, in two steps: the power itself may be out of range."""
    half = np.exp2(np.asarray(log_length) / 2)
    return x / half / half


def clean_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (the components packed, see ``_kind``), dim, norm (its log2) of usable vectors.

    Null, empty or zero vectors and those with a null or non-finite component are left out,
    as are rows without an id.
    """
    kind = _kind(rows)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids, packed, dims, norms = [], [], [], []
            for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not e or None in e:
                    continue
                x = np.array(e, "<f8") + 0.0  # no negative zeros: equal vectors have equal bytes
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids.append(i)
                packed.append(x.astype(kind).tobytes())
                dims.append(len(x))
                norms.append(float(_lengths(x[None])[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(dims, pa.int32()),
                                              pa.array(norms, pa.float64())], names=["vec_id", "v", "dim", "norm"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, v binary, dim int, norm double")


def norm_ranges(sizes: dict[int, int], dim: int, top: float, tables: int, probes: int) -> dict[int, tuple]:
    """Range -> (hashes, log2 of its scale M, probes), from the vectors of each range.

    A range whose buckets are all probed needs one table only.
    """
    out = {}
    for r, n in sizes.items():
        hashes, count = CrossPolytopes(dim, -(-n // ROWS), tables), math.ceil(probes * math.sqrt(max(1, n / PROBED)))
        if math.prod(2 * axes for axes in hashes.axes) <= count:
            hashes = CrossPolytopes(dim, -(-n // ROWS), 1)
        out[r] = hashes, top - r / 2, count
    return out


def _range_of(norm, top: float):
    """Range of a norm (as its log2): 0 for the largest, the next for each factor of sqrt(2) below."""
    return F.floor(2 * (F.lit(top) - norm)).cast("int")


def indexed(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with norms up to ``2 ** top`` as unit vectors with one more component."""
    x = _scaled(x, top)
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def _hash_rows(rows: DataFrame, ranges: dict[int, tuple], dim: int, tables: int, queries: bool, kind: str) -> DataFrame:
    """(id, tab, code) for each row (id, v, range) and table: its bucket, or, for queries, the
    buckets it probes in the tables of all ranges."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = _vectors(part.column(1).to_pylist(), dim, kind)
                mine = part.column(2).to_numpy()
                for r, (hashes, top, probes) in ranges.items():
                    here = np.arange(len(x)) if queries else np.flatnonzero(mine == r)
                    if not len(here):
                        continue
                    unit = _scaled(x, _lengths(x)[:, None]) if queries else indexed(x[here], top)
                    for t in range(hashes.tables):
                        codes = hashes.probes(unit, t, probes) if queries else hashes.codes(unit, t)[:, None]
                        at_row = np.repeat(here, codes.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(at_row)), pa.array(np.full(len(at_row), r * tables + t, np.int32)),
                             pa.array(codes.reshape(-1))], names=["id", "tab", "code"])

    return rows.select("id", "v", "range").mapInArrow(run, "id long, tab int, code long")


def _best(dim: int, k: int, kind: str):
    """Per block of one bucket: each query's best classes, by inner product, then first id."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf.is_query], pdf[~pdf.is_query]
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "first_id": [], "score": []}).astype(
                {"query_id": "int64", "first_id": "int64", "score": "float64"})
        qv, cv = _vectors(q.v, dim, kind), _vectors(c.v, dim, kind)
        ids, queries = c.id.to_numpy(), q.id.to_numpy()
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            product, take = qv @ cv.T, min(len(ids), k)
            known = np.isfinite(product)  # others are computed again, whatever the cut
            cut = np.partition(np.where(known, product, -np.inf), len(ids) - take, axis=1)[:, len(ids) - take]
            # a matrix product rounds by its blocking: all that may tie with the last one are computed again
            margin = 4 * dim * np.finfo(float).eps * np.exp2(_lengths(qv) + _lengths(cv).max())
            row, col = np.nonzero(~known | (product >= (cut - margin)[:, None]))
            score = np.concatenate([(qv[row[i:i + PAIRS]] * cv[col[i:i + PAIRS]]).sum(axis=1)  # the same sum wherever the pair meets
                                    for i in range(0, len(row), PAIRS)])
            score[np.isnan(score)] = -np.inf
        order = np.lexsort((ids[col], -score, row))
        first = np.searchsorted(row, np.arange(len(queries)))  # row is sorted
        order = order[np.arange(len(row)) - first[row] < take]
        return pd.DataFrame({"query_id": queries[row[order]], "first_id": ids[col[order]], "score": score[order]})

    return run


def _ranked(cells: DataFrame, vectors: DataFrame, dim: int, k: int, kind: str) -> DataFrame:
    """Best classes of each query over blocks of buckets; ``cells``: tab, code, is_query, id;
    ``vectors``: id, v. Only buckets that hold both sides get their vectors."""
    size = cells.groupBy("tab", "code").agg(
        F.sum(F.when(F.col("is_query"), 0).otherwise(1)).alias("n"), F.sum(F.when(F.col("is_query"), 1).otherwise(0)).alias("q"))
    size = size.where("n > 0 and q > 0").select("tab", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"),
                                                F.ceil(F.col("q") / QUERIES).cast("int").alias("qb"))
    rows = cells.join(size, ["tab", "code"]).join(vectors, "id")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("is_query"), F.col("qb")).otherwise(F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("nb")).otherwise(F.col("qb")) - 1))
    rows = rows.withColumn("mine", mine).withColumn("other", other).select(
        "tab", "code", F.when(F.col("is_query"), F.col("other")).otherwise(F.col("mine")).alias("cell"),
        F.when(F.col("is_query"), F.col("mine")).otherwise(F.col("other")).alias("turn"), "is_query", "id", "v")
    found = rows.groupBy("tab", "code", "cell", "turn").applyInPandas(_best(dim, k, kind), "query_id long, first_id long, score double")
    found = found.distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest rows (largest inner product) found for each query row of ``vectors``.

    ``vectors``: vec_id, embedding (array of float or double); ``is_query``: a condition on
    vec_id. Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller
    vec_id; a query's own row is no candidate. Components of any finite size take part: a product
    beyond a double's range scores infinite, one without a value (infinities of both signs) minus
    infinite. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do rows without an id; vectors of another
    dimension than the query meet only their own kind. Repeated rows of an id count once (of
    different vectors under one id the first in byte order). With fewer than k other rows all
    are returned; an empty table gives no rows; other columns are ignored.
    """
    spark, kind = vectors.sparkSession, _kind(vectors)
    rows = clean_vectors(vectors).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("s")).select("vec_id", "s.*")
    rows = stored(rows, "ann-rows")
    out = None
    for dim, n, top in sorted((r["dim"], r["n"], r["top"]) for r in rows.groupBy("dim").agg(
            F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()):
        part = _nearest(rows.where(F.col("dim") == dim), dim, n, top, is_query, k, tables, probes, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _nearest(rows: DataFrame, dim: int, n: int, top: float, is_query, k: int, tables: int, probes: int,
             kind: str) -> DataFrame:
    # equal vectors are one class, known by its first id; k + 1 of its ids are enough for any query
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    listed = stored(rows.select("vec_id", "v", _range_of(F.col("norm"), top).alias("range")).withColumn("place", place).where(F.col("place") <= k + 1), "ann-classes")
    index = listed.where("place = 1").select(F.col("vec_id").alias("id"), "v", "range")
    # one row per factor of sqrt(2) between the least and the greatest double: at most some 4,200
    counts = sorted((r["range"], r["n"]) for r in index.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    last = counts[min(len(counts), RANGES) - 1][0]  # ranges without vectors do not count
    sizes = dict(counts[:RANGES])
    sizes[last] += sum(n for _, n in counts[RANGES:])
    index = index.withColumn("range", F.least("range", F.lit(last)))
    queries = rows.where(is_query).select(F.col("vec_id").alias("id"), "v", F.lit(0).alias("range"))
    ranges = norm_ranges(sizes, dim, top, tables, probes)
    vectors = rows.select(F.col("vec_id").alias("id"), "v")
    cells = (_hash_rows(index, ranges, dim, tables, False, kind).withColumn("is_query", F.lit(False))
             .unionByName(_hash_rows(queries, ranges, dim, tables, True, kind).withColumn("is_query", F.lit(True))))
    # one class more than asked for: the query's own class may hold nothing but the query
    found = stored(_ranked(stored(cells, "ann-cells"), vectors, dim, k + 1, kind), "ann-found")

    def expanded(found: DataFrame) -> DataFrame:
        ids = listed.join(index.select(F.col("id").alias("first_id"), F.col("v").alias("w")), F.col("v") == F.col("w"))
        ids = ids.select("first_id", "vec_id")
        hits = found.join(ids, "first_id").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    hits = stored(expanded(found), "ann-hits")
    # queries short of k: all vectors, block by block
    short = (queries.join(hits.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left")
             .where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select("id", "v"))
    blocks = -(-n // BLOCK)
    wide = (index.select("id", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("code"))
            .unionByName(short.select("id", F.lit(True).alias("is_query"),
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("code"))))
    again = expanded(_ranked(wide.withColumn("tab", F.lit(-1)), vectors, dim, k + 1, kind))
    return hits.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def recall(vectors: DataFrame, found: DataFrame, is_query, k: int = 20) -> float:
    """Share of the true k nearest that ``found`` holds, by brute force in blocks of the table."""
    rows = clean_vectors(vectors)
    dim, n = rows.agg(F.max("dim"), F.count(F.lit(1))).first()
    blocks = -(-n // BLOCK)
    cells = (rows.select(F.col("vec_id").alias("id"), F.lit(False).alias("is_query"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("code"))
             .unionByName(rows.where(is_query).select(F.col("vec_id").alias("id"), F.lit(True).alias("is_query"),
                                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("code"))))
    true = _ranked(cells.withColumn("tab", F.lit(0)), rows.select(F.col("vec_id").alias("id"), "v"), dim, k + 1,
                   _kind(vectors)).where("query_id <> first_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_id"))
    true = true.withColumn("r", rank).where(F.col("r") <= k).select("query_id", F.col("first_id").alias("vec_id"))
    both = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, true.count())
