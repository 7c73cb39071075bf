"""Paths of labels as a tree (R-2, R-3).

``tree_edges`` turns rows of level labels into the distinct edges of their trie:
``(level, parent_path, label)``. Each row yields one edge per level through a single
``inline`` generator; the distinct then runs with a partial aggregate before the shuffle
and hashes on the whole edge, so a root that owns a third of the rows is spread over
as many tasks as its edges hash to.

``tree_nodes`` gives the same trie by node ids: a node's id is a 128-bit hash of its parent's
id and its own label, so ids chain from the root and each row can work out its own. An
edge carries 16 bytes of its parent instead of the parent's whole path, at any depth, and
the path text is kept once per node, as the label. ``node_paths`` puts the paths back.

``tree_json_fragments`` renders the nested form ``{label: {label: {...}}}`` without
gathering a tree anywhere: every node gets a text fragment that depends only on itself
and, for a leaf, on how many of its prefixes it is the greatest path under (told by the next
path in sorted order, or a partial ``max`` per short prefix, then a count). Written in path order (``orderBy`` is a
range-partitioned sort), the part files concatenate to the document. The plan has the
same size at any depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pursewise.functions.text import json_value

# Fixed value: joins the labels of a parent path; no label contains it.
PATH_SEP = "\u001f"


def pair_label(code: str | Column, desc: str | Column, sep: str = "-") -> Column:
    """R-2: ``code-desc``; a null part is skipped (as ``concat_ws`` does)."""
    code = F.col(code) if isinstance(code, str) else code
    desc = F.col(desc) if isinstance(desc, str) else desc
    return F.concat_ws(sep, code, desc)


def _label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def tree_edges(levels_df: DataFrame, sep: str = PATH_SEP) -> DataFrame:
    """R-3 (a): distinct ``(level, parent_path, label)`` of the rows' label paths.

    ``levels_df`` holds one column per level, root first. Null labels become ''.
    """
    names = levels_df.columns
    labels = [_label(F.col(f"`{n}`")) for n in names]
    edges = F.array(*[
        F.struct(F.lit(i + 1).alias("level"),
                 F.concat_ws(sep, *labels[:i]).alias("parent_path") if i else F.lit("").alias("parent_path"),
                 labels[i].alias("label"))
        for i in range(len(names))
    ])
    return levels_df.select(F.inline(edges)).distinct()


# Fixed value: the parent of a root, in hexadecimal (no node has it but by a hash of zero).
ROOT_ID = "0" * 32


def node_id(parent: Column, label: Column) -> Column:
    """The id of the node ``label`` under ``parent``, both ids as hexadecimal text. A parent's
    id always has 32 digits, so two different pairs never give the same text to hash."""
    return F.md5(F.concat(parent, label))


# A path as one text: its labels, each but the last ended by _END. Where a label holds _END or _MARK, they are written as
# _MARK and a second sign, so that the texts sort as the lists of labels do.
_END, _MARK = "\u0000", "\u0001"
_ESCAPED = ((_MARK, _MARK + "\u0002"), (_END, _MARK + _MARK))


def _path_text(labels: Sequence[Column]) -> Column:
    for plain, escaped in _ESCAPED:
        labels = [F.replace(c, F.lit(plain), F.lit(escaped)) for c in labels]
    return F.concat_ws(_END, *labels)


def _path_labels(text: Column) -> Column:
    def plain(label: Column) -> Column:
        for sign, escaped in reversed(_ESCAPED):
            label = F.replace(label, F.lit(escaped), F.lit(sign))
        return label

    labels = F.split(text, _END)
    return F.when(text.contains(_MARK), F.transform(labels, plain)).otherwise(labels)


def _spread(levels_df: DataFrame) -> tuple[DataFrame, int]:
    """The distinct paths as (path, _h), each path a text, dealt by a hash of their first third, and how many
    levels that is. All paths under such a prefix lie in one partition. Both shuffles (distinct,
    prefix) carry the text alone: half the bytes of a list of labels, and the hash is worked out behind them."""
    n = len(levels_df.columns)
    k = -(-n // 3)
    prefix = F.xxhash64(F.substring_index("path", _END, k))
    paths = levels_df.select(_path_text([_label(F.col(f"`{c}`")) for c in levels_df.columns]).alias("path"))
    return paths.distinct().repartition(prefix).withColumn("_h", prefix), k


def _shared(path: Column, other: Column, n: int) -> Column:
    """How many leading labels the paths share (none with a null path)."""
    out = F.when(other.isNull(), 0)
    for i in range(n):
        out = out.when(path[i] != other[i], i)
    return out.otherwise(n)


def tree_nodes(levels_df: DataFrame) -> DataFrame:
    """R-3 (a) by ids: distinct ``(level, node_id, parent_id, label)``, ids as binary(16).

    ``levels_df`` holds one column per level, root first; null labels become ''. The
    distinct paths are shuffled once more, by a prefix of ``k`` levels, and sorted: a path then
    opens the nodes below those it shares with the path before it, so the many nodes from level ``k``
    down are found without a shuffle of edges. The few above are the distinct edges of
    the distinct prefixes, hashed on (level, parent_id, label).
    """
    n = len(levels_df.columns)
    paths, k = _spread(levels_df)
    before = F.lag("path").over(Window.partitionBy("_h").orderBy("path"))
    both = paths.select("path", before.alias("_before"))
    rows = both.select(*[_path_labels(F.col(c)).alias(c) for c in both.columns]).select(
        "path", _shared(F.col("path"), F.col("_before"), n).alias("_up"))
    parent = F.lit(ROOT_ID)
    for i in range(n):  # one projection a level: an id is worked out once
        rows = rows.withColumn(f"_id{i + 1}", node_id(parent, F.col("path")[i]))
        parent = F.col(f"_id{i + 1}")
    new = F.array(*[F.when(F.col("_up") < i, F.struct(
        F.lit(i).alias("level"), F.unhex(F.col(f"_id{i}")).alias("node_id"),
        F.unhex(F.col(f"_id{i - 1}") if i > 1 else F.lit(ROOT_ID)).alias("parent_id"), F.col("path")[i - 1].alias("label")))
        for i in range(k, n + 1)])
    deep = rows.select(F.inline(new)).where("level is not null")
    if k == 1:
        return deep
    short = paths.select(F.substring_index("path", _END, k - 1).alias("path")).distinct()
    rows, parent = short.select(_path_labels(F.col("path")).alias("path")), F.lit(ROOT_ID)
    for i in range(k - 2):
        rows = rows.withColumn(f"_id{i + 1}", node_id(parent, F.col("path")[i]))
        parent = F.col(f"_id{i + 1}")
    edges = F.array(*[F.struct(F.lit(i).alias("level"), F.unhex(F.col(f"_id{i - 1}") if i > 1 else F.lit(ROOT_ID)).alias("parent_id"),
                               F.col("path")[i - 1].alias("label")) for i in range(1, k)])
    own = F.unhex(node_id(F.lower(F.hex("parent_id")), F.col("label")))
    return rows.select(F.inline(edges)).distinct().select("level", own.alias("node_id"), "parent_id", "label").unionByName(deep)


def node_paths(nodes: DataFrame, depth: int, sep: str = PATH_SEP) -> DataFrame:
    """``tree_edges`` from ``tree_nodes``: (level, parent_path, label), for those who need the
    text. Each level is joined to the one above it by id; the join is split by AQE where a
    parent has very many children."""
    above = nodes.where("level = 1").select("node_id", F.lit("").alias("parent_path"), "label")
    out = above.select(F.lit(1).alias("level"), "parent_path", "label")
    for level in range(2, depth + 1):
        parents = above.select(F.col("node_id").alias("parent_id"), F.col("label").alias("_label") if level == 2 else
                               F.concat_ws(sep, "parent_path", "label").alias("_label"))
        above = nodes.where(F.col("level") == level).join(parents, "parent_id").select(
            "node_id", F.col("_label").alias("parent_path"), "label")
        out = out.unionByName(above.select(F.lit(level).alias("level"), "parent_path", "label"))
    return out


def tree_json_fragments(levels_df: DataFrame) -> DataFrame:
    """R-3 (b): ``(path, fragment)``; ``'{' + concat(fragments ordered by path) + '}'``
    is the nested document ``{root: {child: {... {leaf: {}}}}}``.

    Every row of ``levels_df`` has the same depth ``n``, so leaves are the full paths.
    In path order an inner node opens ``"label":{``; a leaf writes ``"label":{}``, then
    closes each ancestor whose last descendant it is, then a comma unless it is the last
    leaf of all. A leaf closes ``min(run, n - 1)`` ancestors where ``run`` counts the prefix
    lengths ``m`` in ``0..n-1`` under which it is the greatest path; those form a run
    from ``n-1`` down, so counting is enough.

    The distinct paths are dealt by a prefix of ``k`` levels and sorted (as in ``tree_nodes``): the
    paths before and after tell the nodes from level ``k`` down that a path opens and
    closes. Only the last path of each prefix is looked at further: one group per shorter prefix keeps
    the greatest (a partial ``max``, so a hot root costs one partial row per task), and one
    group per node counts how often it is that.
    """
    n = len(levels_df.columns)
    paths, k = _spread(levels_df)
    w = Window.partitionBy("_h").orderBy("path")
    path = F.col("path")
    key = json_value(F.element_at("path", -1))
    both = paths.select("path", F.lag("path").over(w).alias("_before"), F.lead("path").over(w).alias("_after"))
    rows = both.select(*[_path_labels(F.col(c)).alias(c) for c in both.columns]).select(
        "path", _shared(path, F.col("_before"), n).alias("_up"), _shared(path, F.col("_after"), n).alias("_down"))
    comma, brace = F.lit(","), F.lit("}")
    opened = [F.when(F.col("_up") < i, F.struct(F.slice("path", 1, i).alias("path"),
                                                F.concat(json_value(path[i - 1]), F.lit(":{")).alias("fragment")))
              for i in range(k, n)]
    closing = F.concat(key, F.lit(":{}"), F.repeat(brace, (F.lit(n - 1) - F.col("_down")).cast("int")), comma)
    leaf = F.when(F.col("_down") >= k, F.struct(path, closing.alias("fragment")))
    deep = rows.select(F.inline(F.array(*opened, leaf))).where("path is not null")

    same = F.substring_index("path", _END, k).eqNullSafe(F.substring_index("_after", _END, k))
    last = both.where(~same).select(_path_labels(path).alias("path"))  # where _down < k
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: F.slice("path", 1, m))
    greatest = last.select("path", F.explode(F.concat(prefixes, F.array("path"))).alias("prefix")).groupBy("prefix").agg(
        F.max("path").alias("last"))
    marks = F.array(F.struct(F.col("prefix").alias("path"), F.lit(0).alias("ends")),
                    F.struct(F.col("last").alias("path"), F.lit(1).alias("ends")))
    nodes = greatest.select(F.inline(marks)).where(F.size("path") > 0).groupBy("path").agg(F.sum("ends").alias("ends"))
    run = F.col("ends") - 1 + (n - k)  # a leaf is the greatest path under itself
    end = F.concat(key, F.lit(":{}"), F.repeat(brace, F.least(run, F.lit(n - 1)).cast("int")),
                   F.when(run < n, comma).otherwise(F.lit("")))
    top = nodes.select("path", F.when(F.size("path") == n, end).otherwise(F.concat(key, F.lit(":{"))).alias("fragment"))
    return deep.unionByName(top)


def write_tree_json(levels_df: DataFrame, path: str) -> None:
    """Write the nested document as ordered text part files; read in part order they
    concatenate to the JSON. Sorting is distributed; no part holds more than its range."""
    frags = tree_json_fragments(levels_df).withColumn("_section", F.lit(1))
    spark = levels_df.sparkSession
    braces = spark.createDataFrame([(0, "{"), (2, "}")], "_section int, fragment string").select(
        F.array().cast("array<string>").alias("path"), "fragment", "_section")
    doc = frags.unionByName(braces)
    doc.orderBy("_section", "path").select("fragment").write.mode("overwrite").text(path)
