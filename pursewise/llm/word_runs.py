"""Periodic runs of words by string synchronising sets (operator 11).

A run is a stretch of words with smallest period q, at least MIN_TIMES periods and MIN_WORDS
words long, that no neighbour extends. They are found in three ways:

* Scales t = 8, 16, 32, ...: the synchronising set of scale t holds the positions i where the
  least hash of the t-word grams at i .. i+t lies at i or at i+t. Whether i belongs to it depends
  on the 2t words from i only, and every stretch of t positions holds one unless the words there
  have a period of t/3 or less. A run with q in [t, 2t) therefore has a position x of the set among
  its first t words, and its 2t words recur next at x+q, in the set too: the pair proposes q.
* Highly periodic regions are told apart first, by the distance at which t/2-word grams recur, and
  give no ids: their grams would all be alike. Their periods are those of smaller scales.
* Periods under 8 are found by comparing the words with themselves, shifted.

A proposal is kept if three periods follow x, and is then extended over the words themselves.
The work is n log n in a text's words and reads no other text, so nothing is shuffled. Texts of a
batch go through the arrays together, each with hashes of its own, so that none matches another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import BLANKS, U64, batches, bound, mixed, word_hashes

MIN_TIMES, MIN_WORDS = 4, 6
#: The smallest scale; periods below are compared directly.
FIRST = 8
_NONE = U64(2**64 - 1)
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _doubled(g: np.ndarray, size: int) -> np.ndarray:
    """Hashes of grams of ``2 * size`` words from those of ``size`` words."""
    if len(g) <= size:
        return g[:0]
    return mixed(g[:-size] * _A + mixed(g[size:] + _B))


def _next(g: np.ndarray) -> np.ndarray:
    """Distance to the next equal value, 0 without one."""
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    out = np.zeros(len(g), np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _least(a: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have < size:
        step = min(have, size - have)
        a = np.minimum(a[:len(a) - step], a[step:])
        have += step
    return a


def _same_ahead(w: np.ndarray, a: int, b: int, step: int) -> int:
    """Words from ``a`` and from ``b`` > a that agree one by one, forwards or backwards."""
    done, size = 0, 64
    while True:
        if step > 0:
            size_now = min(size, len(w) - b - done)
            differ = w[a + done:a + done + size_now] != w[b + done:b + done + size_now]
        else:
            size_now = min(size, a - done)
            differ = (w[a - done - size_now:a - done] != w[b - done - size_now:b - done])[::-1]
        if size_now <= 0:
            return done
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += size_now
        size *= 2


def synchronising_set(half: np.ndarray, gram: np.ndarray, scale: int) -> np.ndarray:
    """Positions of the set of ``scale``; ``half`` and ``gram``: grams of scale/2 and scale words."""
    ahead = _next(half)
    i = np.flatnonzero((ahead > 0) & (ahead <= scale // 3))
    i = i[i < len(gram)]
    d = ahead[i]
    periodic = i[half[i + scale // 2 - d] == half[i + scale // 2]]
    ids = gram.copy()
    ids[periodic] = _NONE
    if len(ids) <= scale:
        return np.empty(0, np.int64)
    low = _least(ids, scale + 1)
    return np.flatnonzero((low != _NONE) & ((low == ids[:len(low)]) | (low == ids[scale:])))


def _small(w: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, min(FIRST, len(w))):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q < max(MIN_WORDS, MIN_TIMES * q):
                continue
            e = b + q
            if not any(q % d == 0 and (w[a:e - d] == w[a + d:e]).all() for d in range(1, q)):
                out.append((a, e - a, q))
    return out


def _of_scale(w: np.ndarray, half: np.ndarray, gram: np.ndarray, twice: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    x = synchronising_set(half, gram, scale)
    x = x[x < len(twice)]
    order = np.argsort(twice[x], kind="stable")
    x = x[order]
    c = twice[x]
    pair = np.flatnonzero(c[1:] == c[:-1])
    q = x[pair + 1] - x[pair]
    x = x[pair]
    fits = (q >= scale) & (q < 2 * scale) & (x + 3 * q <= len(w))
    x, q = x[fits], q[fits]
    three = twice[x + 2 * (q - scale)] == twice[x + 3 * q - 2 * scale]
    x, q = x[three], q[three]
    order = np.lexsort((x, q))
    out, last, until = [], 0, 0
    for p, d in zip(x[order].tolist(), q[order].tolist()):
        if d == last and p < until:
            continue
        start = p - _same_ahead(w, p, p + d, -1)
        end = p + d + _same_ahead(w, p, p + d, 1)
        last, until = d, end - d
        if end - start >= max(MIN_WORDS, MIN_TIMES * d):
            out.append((start, end - start, d))
    return out


def find_runs(hashes: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period, of each of the texts whose word hashes
    follow each other in ``hashes``."""
    n_texts = len(counts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    # own hashes for each text, and one word of its own after it
    text = np.repeat(np.arange(n_texts), counts + 1)
    stop = np.cumsum(counts + 1) - 1
    w = np.empty(len(text), U64)
    inside = np.ones(len(text), bool)
    inside[stop] = False
    w[inside] = hashes
    w[~inside] = _NONE
    w = mixed(w + mixed(np.arange(1, n_texts + 1, dtype=U64))[text])
    first = stop - counts

    def put(runs, where=None):
        for s, length, q in runs:
            i = text[s] if where is None else text[where[s]]
            at = s if where is None else int(where[s])
            found[i].append((int(at - first[i]), int(length), int(q)))

    put(_small(w))
    # a longer period repeats 8-word grams: only texts with such go on
    gram, size = w, 1
    while size < FIRST and len(gram):
        gram, size = _doubled(gram, size), size * 2
    if len(gram):
        again = np.zeros(n_texts, bool)
        again[text[np.flatnonzero(_next(gram))]] = True
        where = np.flatnonzero(again[text])
        w = w[where]
        longest = int(counts[again].max()) if again.any() else 0
        grams = {1: w}
        size = 1
        while size < 2 * FIRST:
            grams[2 * size] = _doubled(grams[size], size)
            size *= 2
        scale = FIRST
        while MIN_TIMES * scale <= longest:
            put(_of_scale(w, grams[scale // 2], grams[scale], grams[2 * scale], scale), where)
            del grams[scale // 2]
            grams[4 * scale] = _doubled(grams[2 * scale], 2 * scale)
            scale *= 2
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [x for x, k in zip(words, keep.tolist()) if k]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames, 1, 2_000_000):
        words = [(t or "").encode("utf-8", "replace").split() for t in b.column(1).to_pylist()]
        found = find_runs(*word_hashes([b" ".join(w) for w in words]))
        sizes = np.cumsum([0] + [len(r) for r in found])
        flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
        runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN.value_type)))
        kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``runs`` is an array of (start, length, period) by start,
    then period; ``collapsed`` the words that no run holds after its first period, joined by one
    space. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Null ids
    stay null, repeated rows give a row each, an empty table none; other columns are ignored.
    Texts of any length are read whole; a task holds one text and some arrays of its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _runs, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


# ------------------------------------------------------------------ the registered query

def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten, by the crc32 of its id, repeats some of its words:
    from word a on, word i is word a + (i - a) % p (see the query's contract); null ids are left."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(block), F.lit(1), n - a)), " ")

    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    changed = (h % 10 == 0) & (F.length(bare) > 0)
    return docs.select("doc_id", F.when(changed, bound(F.split(bare, r"[\x20\x09-\x0D]+"), repeated)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of rows of ``periodic_runs``: doc_id, n_runs, the run with the greatest exponent (start,
    length, period, exponent_milli; the first of equals), runs_sha256, collapsed_sha256."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                     F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
