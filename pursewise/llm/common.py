"""Helpers shared by the operators of this folder: shared tables, words, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursewise.session import ensure_checkpoint_dir, ship_package

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Once per query: the package on the executors, and small Arrow batches.

    Documents may be long. Batches of a few MB bound what the JVM and the Python worker of a
    task hold at a time; the results do not depend on it.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage at a table that every executor can read, so a lost executor costs a
    re-read and not a re-computation, and row ids given before the write stay as they are.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------ word hashes (in tasks)

U64 = np.uint64


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when it holds ``limit`` words (bounded memory)."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit integers (every input bit reaches every output bit)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def batches(frames: Iterator[pa.RecordBatch], column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of a text column, one row at least.

    Bounds what a task holds of split texts, however long the documents of a batch are.
    """
    for b in frames:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop


# ------------------------------------------------------------------ connected components

def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root = the smallest node.

    ``edges`` has two columns u, v of longs. Alternates the large-star and small-star steps
    of Kiveris et al. (2014): each node's neighbours are pointed at the smallest of them,
    until nothing changes. The minimum per node is a partial aggregate, the join back splits
    a hot node (AQE), and each round ends in a table in the shared folder. Only two numbers a
    round reach the driver. Nodes without an edge are not in the result.
    """
    cur = stored(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), f"{name}-edges")
    state = None
    for _ in range(max_rounds):
        # large star: larger neighbours point at the smallest node of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: every smaller neighbour, and the node itself, point at the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        nxt = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = stored(nxt, f"{name}-round")
        got = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == state:
            break
        state = (got["n"], got["s"])
    else:
        raise RuntimeError("connected components did not settle")
    # settled: a forest of stars, every node but the roots points at its root
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))


# ------------------------------------------------------------------ word hashes (whole arrays)

_words_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _words_rng.integers(0, 2**64, 256, dtype=U64)
_PLACE = _words_rng.integers(0, 2**64, 4096, dtype=U64) | U64(1)
_IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
#: Bytes hashed at a time: the temporary arrays are some 30 times as large.
PIECE = 1 << 20


def _piece_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of ``piece``: a multilinear hash of its bytes, then mixed."""
    a = np.frombuffer(piece, np.uint8)
    word = ~_IS_BLANK[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, U64), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = _BYTE[a[word]] * _PLACE[place & 4095]
    if sizes.max() > 4096:
        value *= (2 * (place >> 12) + 1).astype(U64)
    return mixed(np.add.reduceat(value, first) + sizes.astype(U64) * _PLACE[0]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts in turn, number of words of each text)."""
    counts = np.zeros(len(texts), np.int64)
    out = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:  # a long text goes in pieces that end at a blank
            text, begin = texts[at], 0
            while begin < len(text):
                end = begin + PIECE
                while end < len(text) and not _IS_BLANK[text[end]]:
                    end += 1
                h = _piece_hashes(text[begin:end])[0]
                out.append(h)
                counts[at] += len(h)
                begin = end
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and size + len(texts[stop]) <= PIECE:
            size += len(texts[stop]) + 1
            stop += 1
        stop = max(stop, at + 1)
        h, starts = _piece_hashes(b"\n".join(texts[at:stop]))
        ends = np.cumsum([len(t) + 1 for t in texts[at:stop]])
        counts[at:stop] = np.diff(np.searchsorted(starts, ends), prepend=0)
        out.append(h)
        at = stop
    return np.concatenate(out) if out else np.empty(0, U64), counts
