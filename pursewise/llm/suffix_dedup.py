"""Repeated passages by prefix-partitioned suffix trees (operator 12).

The suffixes of all texts (at word positions) are split by the words they begin with, a tree is
built of each part in the memory of one task, and its internal nodes of at least ``WINDOW``
words are the repeats. What makes this cheap at scale:

* One text stands for all equal ones; the others repeat it whole.
* The first key of a suffix is taken from its prefix of ``WINDOW`` words: the least hash of the
  ``GRAM``-word grams in it. Equal prefixes have equal keys, and some twenty neighbouring
  suffixes share one, so they travel as one row (a bundle) and not as fifty words each.
* A key found in one text only cannot lead to a repeat: its suffixes are leaves and never sent.
* Equal bundles are one row before they are sent (map-side), so copies make no group large.
* A task reads the bundles in key order and builds a tree for as many whole keys as fit its
  memory (``GROUP`` words). The suffixes of a key with more words are split by a longer prefix,
  the whole ``WINDOW`` words; each such part is one node, its least document a partial aggregate.

The topmost node of at least ``WINDOW`` words above a suffix holds every place where its first
``WINDOW`` words occur, so the node's least document decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import U64, batches, mixed, stored, word_hashes

#: Words of a passage; words of a gram in a key; words of all bundles of one tree.
WINDOW, GRAM, GROUP = 50, 8, 1 << 18
#: Tasks over which the texts of one key are dealt.
SALTS = 16

_rng = np.random.Generator(np.random.PCG64(20241012))
_AT = _rng.integers(0, 2**64, WINDOW, dtype=U64) | U64(1)


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    out = h[:n] * _AT[0]
    for k in range(1, size):
        out += h[k:n + k] * _AT[k]
    return mixed(out)


def _least(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values (doubling the run)."""
    have = 1
    while have < size:
        step = min(have, size - have)
        a = np.minimum(a[:len(a) - step], a[step:])
        have += step
    return a


def keys_of(h: np.ndarray) -> np.ndarray:
    """Key of each suffix with at least WINDOW words."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64)
    return _least(_windows(h, GRAM), WINDOW - GRAM + 1).view(np.int64)


# ------------------------------------------------------------------ first reading

def _text_key() -> Column:
    return F.unhex(F.md5("text"))


_BASE = "doc_id long, text_key binary, n_words long, whole_sha256 string, suffix_keys array<long>"


def _first_reading(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames, 2, 2_000_000):
        words = [(t or "").encode("utf-8", "replace").split() for t in b.column(2).to_pylist()]
        h, n = word_hashes([b" ".join(w) for w in words])
        ends = np.cumsum(n)
        keys = [np.unique(keys_of(h[e - k:e])) if k >= WINDOW else np.empty(0, np.int64) for e, k in zip(ends, n)]
        sizes = np.cumsum([0] + [len(k) for k in keys])
        listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha), listed],
                                         names=["doc_id", "text_key", "n_words", "whole_sha256", "suffix_keys"])


# ------------------------------------------------------------------ bundles of suffixes

_BUNDLE = pa.schema([("text_key", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("suffixes", pa.int64()),
                     ("key", pa.int64()), ("words_hash", pa.binary()), ("words", pa.binary())])
_BUNDLE_SQL = "text_key binary, doc long, start long, suffixes long, key long, words_hash binary, words binary"


def _bundles(with_words: bool):
    """Rows (text_key, doc, text, keys that other texts hold too) to their bundles.

    A bundle is a longest run of neighbouring suffixes with one key; its words reach to the
    end of the last suffix's prefix.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 2, 2_000_000):
            rows = []
            h, n = word_hashes([t.encode("utf-8", "replace") for t in b.column(2).to_pylist()])
            end = 0
            for i, size in enumerate(n):
                end += size
                own = h[end - size:end]
                keys = keys_of(own)
                if not len(keys):
                    continue
                starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
                stops = np.append(starts[1:], len(keys))
                shared = np.isin(keys[starts], np.array(b.column(3)[i].as_py(), np.int64))
                text_key, doc = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for s, e in zip(starts[shared].tolist(), stops[shared].tolist()):
                    words = own[s:e + WINDOW - 1].tobytes()
                    rows.append((text_key, doc, s, e - s, int(keys[s]), xxhash.xxh3_128_digest(words),
                                 words if with_words else None))
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BUNDLE)], schema=_BUNDLE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BUNDLE)], schema=_BUNDLE)
    return run


# ------------------------------------------------------------------ trees

def suffix_order(words: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of a suffix tree's leaves, and for each the words
    it shares with the one before (up to 64).

    ``ends``: for each position, where its text ends. Ranks of 1, 2, 4, ... words by doubling.
    """
    n = len(words)
    at = np.arange(n)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    ranks = [rank]
    for k in range(6):
        step = 1 << k
        inside = at + step < ends
        follow = np.zeros(n, np.int64)
        follow[inside] = rank[at[inside] + step]
        rank = np.unique(rank * (n + 2) + follow, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
    order = starts[np.argsort(rank[starts], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        end_a, end_b = ends[a], ends[b]
        for k in range(6, -1, -1):  # ranks of texts that end sooner differ, so equal ranks are equal words
            step = 1 << k
            fits = (a + step <= end_a) & (b + step <= end_b)
            same = np.zeros(len(a), bool)
            same[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
            a, b = a + step * same, b + step * same
        shared[1:] = a - order[:-1]
    return order, shared


def _least_documents(bundles: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """Least document of the topmost node of WINDOW words or more above each suffix, in order of
    the bundles (words, suffixes, least document)."""
    sizes = np.array([len(w) for w, _, _ in bundles])
    counts = np.array([k for _, k, _ in bundles])
    stop = np.cumsum(sizes)
    starts = np.repeat(stop - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order, shared = suffix_order(np.concatenate([w for w, _, _ in bundles]), np.repeat(stop, sizes), starts)
    node = np.flatnonzero(shared < WINDOW)  # each such node is a stretch of leaves
    place = np.empty(int(stop[-1]), np.int64)
    place[starts] = np.arange(len(starts))
    docs = np.repeat(np.array([d for _, _, d in bundles], np.int64), counts)
    mine = place[order]
    out = np.empty(len(starts), np.int64)
    out[mine] = np.repeat(np.minimum.reduceat(docs[mine], node), np.diff(np.append(node, len(mine))))
    return out


_FOUND = pa.schema([("key", pa.int64()), ("words_hash", pa.binary()), ("least", pa.int64()), ("gone", pa.binary())])
_FOUND_SQL = "key long, words_hash binary, least long, gone binary"


def _trees(group: int):
    """Rows (key, words_hash, least, most, suffixes, words) in key order to their repeats: a bit
    for each suffix whose prefix an earlier document than the bundle's least one has, or null."""
    def solve(rows):
        if len(rows) == 1 and rows[0][2] == rows[0][3]:
            return None
        least = _least_documents([(np.frombuffer(r[5], U64), r[4], r[2]) for r in rows])
        out, at = [], 0
        for key, words_hash, low, high, k, _ in rows:
            gone = least[at:at + k] < low
            at += k
            if low < high or gone.any():
                out.append((key, words_hash, low, np.packbits(gone).tobytes() if gone.any() else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _FOUND)], schema=_FOUND) if out else None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, last = [], 0, None
        for b in frames:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "words_hash", "least", "most", "suffixes", "words"))):
                if words > group and r[0] != last:
                    got = solve(rows)
                    if got:
                        yield got
                    rows, words = [], 0
                rows.append(r)
                words += len(r[5]) // 8
                last = r[0]
        got = solve(rows) if rows else None
        if got:
            yield got
    return run


_SUFFIX = pa.schema([("key", pa.int64()), ("words_hash", pa.binary()), ("least", pa.int64()), ("at", pa.int64()), ("prefix", pa.binary())])


def _single(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each bundle with the hash of their prefix of WINDOW words."""
    for b in frames:
        for key, words_hash, low, k, words in zip(*(b.column(c).to_pylist() for c in ("key", "words_hash", "least", "suffixes", "words"))):
            for lo in range(0, k, 10_000):
                at = range(lo, min(k, lo + 10_000))
                prefix = [xxhash.xxh3_128_digest(words[8 * i:8 * (i + WINDOW)]) for i in at]
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * m, pa.int64()), pa.array([words_hash] * m, pa.binary()), pa.array([low] * m, pa.int64()),
                     pa.array(at, pa.int64()), pa.array(prefix, pa.binary())], schema=_SUFFIX)


def _packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix numbers of a bundle to its bits."""
    for b in frames:
        gone = []
        for k, at in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            bits = np.zeros(k, bool)
            bits[np.array(at, np.int64)] = True
            gone.append(np.packbits(bits).tobytes() if at else None)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(gone, pa.binary())], schema=_FOUND)


def repeats(contexts: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, words_hash, least, gone) of the bundles that hold a repeat.

    ``contexts``: key, words_hash, least, most (documents with this bundle), suffixes, words; a
    stored table with one row for each distinct bundle.
    """
    size = F.sum(F.col("suffixes") + WINDOW - 1)
    large = contexts.groupBy("key").agg(size.alias("n")).where(F.col("n") > group).select("key")
    rest = contexts.join(large, "key", "left_anti")
    found = (rest.repartition("key").sortWithinPartitions("key")
             .select("key", "words_hash", "least", "most", "suffixes", "words").mapInArrow(_trees(group), _FOUND_SQL))
    # a key above a task's memory: its suffixes split by their whole prefix
    wide = contexts.join(large, "key", "left_semi")
    single = (wide.select("key", "words_hash", "least", "suffixes", "words")
              .mapInArrow(_single, "key long, words_hash binary, least long, at long, prefix binary"))
    node = single.groupBy("prefix").agg(F.min("least").alias("first"))
    gone = (single.join(node, "prefix").where("first < least").groupBy("key", "words_hash", "least")
            .agg(F.collect_list("at").alias("at")))
    whole = wide.select("key", "words_hash", "least", "most", "suffixes").join(
        gone.drop("least"), ["key", "words_hash"], "left").where("at is not null or least < most")
    packed = whole.select("key", "words_hash", "least", "suffixes",
                          F.coalesce("at", F.array().cast("array<long>")).alias("at")).mapInArrow(_packed, _FOUND_SQL)
    return found.unionByName(packed)


# ------------------------------------------------------------------ back to the texts

def _merged(n: int, bundles) -> np.ndarray:
    """Words removed (a mask) by the bundles (start, suffixes, gone or null for all)."""
    edge = np.zeros(n + 1, np.int64)
    for r in bundles:
        if r["gone"] is None:
            at = np.arange(r["start"], r["start"] + r["suffixes"])
        else:
            at = r["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["gone"], np.uint8), count=r["suffixes"]))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_key, text, bundles) to the spans that go and the text that stays."""
    for b in batches(frames, 1, 2_000_000):
        spans, gone, kept = [], [], []
        for text, bundles in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = text.encode("utf-8", "replace").split()
            mask = _merged(len(words), bundles)
            edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
            spans.append([{"start": int(s), "n_words": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
            gone.append(int(mask.sum()))
            kept.append(b" ".join(w for w, g in zip(words, mask.tolist()) if not g).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(gone, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))), pa.array(kept, pa.string())],
            names=["text_key", "n_removed", "spans", "kept_text"])


def _classes(docs: DataFrame, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, least, cut): per row doc_id, text_key, n_words, whole_sha256; the least document of
    each text_key; and text_key, n_removed, spans, kept_text of texts that lose words there."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.select("doc_id", _text_key().alias("text_key"), "text").mapInArrow(_first_reading, _BASE), "suffix-rows")
    # one row for each distinct text; equal arrays, so any of them will do
    each = stored(rows.where("doc_id is not null and n_words > 0").groupBy("text_key")
                  .agg(F.min("doc_id").alias("doc"), F.first("suffix_keys").alias("suffix_keys")), "suffix-each")
    least = each.select("text_key", "doc")
    # a key that many texts hold is dealt over SALTS tasks; the other side has a row for each salt in use
    mark = F.xxhash64("text_key")
    found = each.select("text_key", mark.alias("mark"), F.pmod(mark, F.lit(SALTS)).cast("int").alias("salt"),
                        F.explode("suffix_keys").alias("key"))
    shared = (found.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"),
                                       F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts")).where("lo <> hi"))
    shared = shared.select("key", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt"))
    mine = found.join(shared, ["key", "salt"]).groupBy("text_key").agg(F.collect_list("key").alias("keys"))
    texts = (docs.where("doc_id is not null and text is not null").select(_text_key().alias("text_key"), "doc_id", "text")
             .groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.min_by("text", "doc_id").alias("text")))
    texts = stored(texts.join(mine, "text_key").select("text_key", "doc", "text", "keys"), "suffix-texts")
    contexts = (texts.mapInArrow(_bundles(True), _BUNDLE_SQL).groupBy("key", "words_hash")
                .agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("suffixes").alias("suffixes"),
                     F.first("words").alias("words")))
    result = stored(repeats(stored(contexts, "suffix-contexts"), group), "suffix-repeats")
    places = texts.mapInArrow(_bundles(False), _BUNDLE_SQL).drop("words")
    hit = places.join(result, ["key", "words_hash"])
    bits = F.when(F.col("doc") == F.col("least"), F.col("gone"))
    hit = hit.where("doc > least or gone is not null").select(
        "text_key", F.struct("start", "suffixes", bits.alias("gone")).alias("bundle"))
    hit = hit.groupBy("text_key").agg(F.collect_list("bundle").alias("bundles"))
    cut = texts.select("text_key", "text").join(hit, "text_key").select("text_key", "text", "bundles").mapInArrow(
        _cut, "text_key binary, n_removed long, spans array<struct<start:long,n_words:long>>, kept_text string")
    return rows, least, cut


def _per_row(rows: DataFrame, least: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with ``copy`` (an earlier document has the whole text) and the columns of ``cut``."""
    out = rows.join(least, "text_key", "left").join(cut, "text_key", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("doc"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    lost = F.when(copy, F.col("n_words")).when(F.col("doc_id") == F.col("doc"), F.col("n_removed"))
    return out.withColumn("copy", copy).withColumn("n_removed", F.coalesce(lost, F.lit(0)).cast("long"))


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``spans`` (start, n_words) are the longest stretches whose
    every window of 50 words also starts in a document with a smaller doc_id. Null, empty and
    blank texts have no words, texts under 50 words no window. A row with a null doc_id loses
    nothing and makes nothing go; rows with one doc_id make nothing go in each other. Repeated
    rows give a row each, an empty table none; other columns are ignored. Texts of any length
    are read whole; a task holds one text and its hashes.
    """
    rows, least, cut = _classes(docs, group)
    out = _per_row(rows, least, cut.drop("kept_text"))
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("n_words")))
    none = F.array().cast("array<struct<start:long,n_words:long>>")
    spans = F.when(F.col("n_removed") == 0, none).when(F.col("copy"), all_words).otherwise(F.col("spans"))
    return out.select("doc_id", "n_words", "n_removed", spans.alias("spans"))


def kept_digests(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined
    by one space). Cases as in ``repeated_spans``."""
    rows, least, cut = _classes(docs, group)
    cut = cut.select("text_key", "n_removed", F.sha2("kept_text", 256).alias("cut_sha256"))
    out = _per_row(rows, least, cut)
    sha = (F.when(F.col("n_removed") == 0, F.col("whole_sha256")).when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256))
           .otherwise(F.col("cut_sha256")))
    return out.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


#: The same rows in DuckDB SQL: every window of 50 words, compared in full.
ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select rid, doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') as k
        from (select rid, doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as i from d
              where len(ws) >= {WINDOW} and doc_id is not null)),
first as (select k, min(doc_id) as m from win group by k),
gone as (select distinct rid, unnest(generate_series(i, i + {WINDOW - 1})) as p from win join first using (k) where doc_id > m),
w as (select rid, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from d),
kept as (select rid, string_agg(word, ' ' order by p) as t from w anti join gone using (rid, p) group by rid),
n as (select rid, count(*) as n from gone group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid) left join n using (rid)
"""
