"""Near-duplicate documents by min-max hashing (operator 4).

Every permutation is evaluated once per shingle and gives two signature values, its minimum
and its maximum, so 100 permutations make 200 values. The values are banded (40 bands of 5
rows); each band holds values of five different permutations. Documents with the same
shingle set are one class from the start. Then, on classes:

1. star links: in each bucket of a band, every class is compared with the bucket's smallest
   class, on the full shingle sets; components of the confirmed links are found;
2. the rest: in every bucket that still holds more than one component, the pairs across
   components whose sizes and signatures allow the threshold are compared on the full sets as
   well, inside the bucket's task, which passes on only the links; components again.

A pair that shares a bucket is thus either compared exactly or already in one component, so
no group is expanded into all its pairs and no partner is capped. A pair at the threshold
0.75 misses all 40 bands with probability (1 - 0.75^5)^40 = 2e-5, at 0.8 with 1e-7, and its
signature estimate (200 values, standard deviation 0.031) falls below ``SKETCH_FLOOR`` with
probability 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursewise.llm.common import U64, WordHashes, batches, components, mixed, stored

WORDS_PER_SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Estimated similarity under which a pair is not compared in full: four standard deviations.
SKETCH_FLOOR = 0.62
#: Members compared with one copy of a centre; rows and shingles of one block of a bucket.
PER_SALT, BLOCK, SHINGLES = 512, 2048, 4_000_000

_rng = np.random.Generator(np.random.PCG64(20240601))
_MUL = _rng.integers(0, 2**64, PERMUTATIONS, dtype=U64) | U64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, dtype=U64)
_POS = _rng.integers(0, 2**64, WORDS_PER_SHINGLE, dtype=U64) | U64(1)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS + 1), dtype=U64) | U64(1)
_words = WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (whole text if under five words)."""
    if not text:
        return np.empty(0, U64)
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, the six ASCII blanks
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(_words.__getitem__, words), U64, n)
    if n < WORDS_PER_SHINGLE:
        one = np.array([n], U64)
        for x in h.reshape(n, 1):
            one = mixed(x * U64(0xC2B2AE3D27D4EB4F) + one)
        return one
    s = h[:n - 4] * _POS[0]
    for k in range(1, WORDS_PER_SHINGLE):
        s = s + h[k:n - 4 + k] * _POS[k]
    return np.unique(mixed(s))


def min_max(s: np.ndarray) -> np.ndarray:
    """The 2 * PERMUTATIONS signature values: all minima, then all maxima."""
    low = np.full(PERMUTATIONS, 2**64 - 1, U64)
    high = np.zeros(PERMUTATIONS, U64)
    for at in range(0, len(s), 1024):
        v = _MUL[:, None] * s[None, at:at + 1024] + _ADD[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    return mixed((values.reshape(BANDS, ROWS) * _BAND[:, :ROWS]).sum(axis=1, dtype=U64) + _BAND[:, ROWS]).view(np.int64)


def sketch_bytes(values: np.ndarray) -> bytes:
    """One byte of each signature value, enough to estimate the similarity of two sets."""
    return (mixed(values) >> U64(56)).astype(np.uint8).tobytes()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_shingles", pa.int64()),
                     ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames, 2):
        n, cls, bands, sig = [], [], [], []
        for text in b.column(2):
            s = shingle_set(text.as_py())
            n.append(len(s))
            if len(s):
                v = min_max(s)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(v))
                sig.append(sketch_bytes(v))
            else:
                cls.append(None)
                bands.append(None)
                sig.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=_SKETCH)


def _row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id, row_hash, n_shingles, cls (equal sets), bands, sig."""
    rows = docs.select(F.col("doc_id").cast("long"), _row_hash().alias("row_hash"), "text")
    out = rows.mapInArrow(_sketch, "doc_id long, row_hash long, n_shingles long, cls binary, "
                                   "bands array<long>, sig binary")
    return out.select(F.monotonically_increasing_id().alias("row_id"), "*")


# ------------------------------------------------------------------ exact comparison

def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (center, salt, role): a centre's text first, then its members'."""
    key, have = None, None
    for b in frames:
        center, salt = b.column("center").to_pylist(), b.column("salt").to_pylist()
        role, node = b.column("role").to_pylist(), b.column("node").to_pylist()
        u, v = [], []
        for i, text in enumerate(b.column("text")):
            if role[i] == 0:
                if (center[i], salt[i]) != key:
                    key, have = (center[i], salt[i]), shingle_set(text.as_py())
            elif key == (center[i], salt[i]) and _linked(have, shingle_set(text.as_py())):
                u.append(node[i])
                v.append(center[i])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirmed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (center, node) of ``pairs`` whose full shingle sets reach the threshold.

    ``texts``: (node, text). A centre with many members is copied for every PER_SALT of them,
    so no task holds a hot centre.
    """
    degree = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts"))
    members = pairs.join(degree, "center").select(
        F.col("node"), "center", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("role"))
    centres = degree.select(F.col("center").alias("node"), "center",
                            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                            F.lit(0).alias("role"))
    rows = members.unionByName(centres).join(texts, "node").select("center", "salt", "role", "node", "text")
    return (rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
            .mapInArrow(_confirm, "u long, v long").distinct())


# ------------------------------------------------------------------ the rest of a bucket

def _block_pairs(frames: Iterator[pa.RecordBatch]):
    """((key, blk_a, blk_b), rows) of each block pair; the rows come sorted by them."""
    now, rows = None, []
    for b in frames:
        cols = {c: b.column(c).to_pylist() for c in ("key", "blk_a", "blk_b", "mine", "node", "n", "root", "sig")}
        bands = b.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        for i, text in enumerate(b.column("text")):
            at = (cols["key"][i], cols["blk_a"][i], cols["blk_b"][i])
            if at != now:
                if rows:
                    yield now, rows
                now, rows = at, []
            rows.append((cols["node"][i], cols["mine"][i], cols["n"][i], cols["root"][i], cols["sig"][i], bands[i], text))
    if rows:
        yield now, rows


def _linked_across(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components in each block pair of a bucket.

    A pair is compared on its full sets if its sizes and signatures allow the threshold and
    no earlier band holds it too; components linked here already are not compared again.
    """
    u, v = [], []
    for (key, blk_a, blk_b), rows in _block_pairs(frames):
        rows = list({r[:2]: r for r in rows}.values())  # a repeated text row counts once
        left, right = [r for r in rows if r[1] == blk_a], [r for r in rows if r[1] == blk_b]
        if not left or not right:
            continue
        id_r, n_r, c_r = (np.array([r[k] for r in right], np.int64) for k in (0, 2, 3))
        sig_r = np.frombuffer(b"".join(r[4] for r in right), np.uint8).reshape(len(right), -1)
        bands_r = np.stack([r[5] for r in right])
        parent: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def top(x):
            while x in parent:
                x = parent[x]
            return x

        for node, _, n, root, sig, bands, text in left:
            ok = (c_r != root) & (100 * np.minimum(n_r, n) >= PERCENT * np.maximum(n_r, n))
            if blk_a == blk_b:
                ok &= id_r > node
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            share = (sig_r[at] == np.frombuffer(sig, np.uint8)).mean(axis=1)
            estimate = (share - 1 / 256) / (1 - 1 / 256)
            near = estimate >= SKETCH_FLOOR
            at, estimate = at[near], estimate[near]
            if not len(at):
                continue
            band = int(np.flatnonzero(bands == key)[0])
            first = ~(bands_r[at, :band] == bands[:band]).any(axis=1)
            mine = None
            for j in at[first][np.argsort(-estimate[first], kind="stable")]:
                a, b = top(root), top(int(c_r[j]))
                if a == b:
                    continue
                if mine is None:
                    mine = shingle_set(text.as_py())
                if j not in sets:
                    sets[j] = shingle_set(right[j][6].as_py())
                if _linked(mine, sets[j]):
                    u.append(node)
                    v.append(int(id_r[j]))
                    parent[max(a, b)] = min(a, b)
        if len(u) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def across(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between components that still share a bucket.

    Only buckets with more than one component are read, each pair of their blocks in a task
    of its own. A block holds at most about BLOCK rows and SHINGLES shingles.
    """
    rows = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = stored(rows.join(open_, "key").join(texts.select("node", "n"), "node"), "minmax-open")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key").join(texts.drop("n"), "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "node", "root", "n", "sig", "bands", "text", "mine",
                       F.least("mine", "other").alias("blk_a"), F.greatest("mine", "other").alias("blk_b"))
    return (rows.repartition("key", "blk_a", "blk_b").sortWithinPartitions("key", "blk_a", "blk_b")
            .mapInArrow(_linked_across, "u long, v long").distinct())


# ------------------------------------------------------------------ the operator

def _grouped(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, row_hash, n_shingles, root (of its component), component_id."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs), "minmax-sketches")
    found = rows.where("n_shingles > 0")
    classes = found.groupBy("cls").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("min_id"))
    classes = stored(classes, "minmax-classes")
    # one row stands for its class
    reps = found.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    reps = stored(reps.select(F.col("row_id").alias("node"), F.col("doc_id").alias("rep_id"),
                              F.col("row_hash").alias("rep_hash"), F.col("n_shingles").alias("n"), "bands", "sig"),
                  "minmax-reps")
    banded = reps.select("node", F.explode("bands").alias("key"))
    buckets = (banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"))
               .where("center <> last").select("key", "center"))
    members = stored(banded.join(buckets, "key").select("key", "node", "center"), "minmax-members")
    # the texts that meet others, once; both comparisons read this table
    wanted = members.select("node").distinct().join(reps, "node")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), _row_hash().alias("hash"), "text")
    on = (keyed["hash"] == wanted["rep_hash"]) & keyed["id"].eqNullSafe(wanted["rep_id"])
    texts = stored(keyed.join(wanted, on).select("node", "text", "n", "sig", "bands"), "minmax-texts")

    star = members.where("node <> center").select("center", "node").distinct()
    links = stored(confirmed(texts.select("node", "text"), star), "minmax-star-links")
    more = across(members.select("key", "node"), components(links, "minmax-star"), texts)
    roots = components(links.unionByName(more), "minmax-all")

    per_class = (classes.join(roots, "node", "left")
                 .select("cls", "min_id", F.coalesce("root", "node").alias("root")))
    smallest = per_class.groupBy("root").agg(F.min("min_id").alias("component_id"))
    ids = per_class.join(smallest, "root").select("cls", "root", "component_id")
    out = rows.select("doc_id", "row_hash", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_hash", "n_shingles", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its
    distinct 5-word shingles, or its whole word sequence when it has fewer words. Two
    documents are linked when 100 * |intersection| >= 75 * |union|; component_id is the
    smallest doc_id of the connected component, kept marks that document.

    Null or empty texts and texts of blanks have n_shingles 0, are their own component and
    are kept. A null doc_id is never a component_id unless its component has no other id;
    it is kept only then. Repeated rows give one output row each (rows with one doc_id and
    different texts are separate members). An empty table gives no rows; other columns are
    ignored. Any length of text is read whole.
    """
    out = _grouped(docs).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with its own columns.

    The row with the group's smallest doc_id (null ids last, then the smallest row hash);
    rows without words are kept, repeated ones once.
    """
    rows = _grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash"))
    some = rows.where("n_shingles > 0").groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.row_hash")
    none = rows.where("n_shingles = 0").select("doc_id", "row_hash").distinct()
    kept = some.unionByName(none).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("k"))
    # the rows travel as one value, so their columns may have any names
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row_hash().alias("hash"))
    out = out.join(kept, (F.col("hash") == F.col("k")) & F.col("doc.doc_id").cast("long").eqNullSafe(F.col("d")))
    again = Window.partitionBy("hash", "d").orderBy("hash")
    return out.withColumn("nth", F.row_number().over(again)).where("nth = 1").select("doc.*")


#: The same rows in DuckDB SQL: every pair that shares a shingle, compared in full.
ORACLE = rf"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(text, '') as txt from documents),
w as (select rid, doc_id, regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws from d),
s as (select distinct rid, array_to_string(list_slice(ws, i, i + 4), ' ') as g
      from (select rid, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as a, b.rid as b, count(*) as m from s a join s b on a.g = b.g and a.rid < b.rid group by all),
l as (select p.a, p.b from p join n x on x.rid = p.a join n y on y.rid = p.b where 100 * p.m >= {PERCENT} * (x.n + y.n - p.m)),
e as (select a, b from l union all select b, a from l),
r as (select rid as a, rid as root from n union select e.b as a, r.root from r join e on e.a = r.a),
c as (select r.a as rid, min(w.doc_id) as component_id from r join w on w.rid = r.root group by r.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, w.doc_id) as component_id,
  w.doc_id is not distinct from coalesce(c.component_id, w.doc_id) as kept
from w left join n using (rid) left join c using (rid)
"""
