"""Tree edges and the nested document against a brute-force build on driver rows."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pursewise.operators.tree import ROOT_ID, node_paths, tree_edges, tree_json_fragments, tree_nodes, write_tree_json
from pursewise.operators.heads import label_rows, RECEIPT_LEVELS
from pursewise.sources.fixtures import view
from conftest import SF_SMALL


def _levels(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    return part.select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"),
                       F.col("p_size").cast("string").alias("c"))


def _brute(rows):
    tree = {}
    for r in rows:
        cur = tree
        for x in r:
            cur = cur.setdefault("" if x is None else x, {})
    return tree


def test_edges_match_brute_force(spark):
    lv = _levels(spark)
    rows = [tuple(r) for r in lv.collect()]
    want = set()
    for r in rows:
        for i in range(len(r)):
            want.add((i + 1, "\u001f".join(r[:i]), r[i]))
    got = {(e["level"], e["parent_path"], e["label"]) for e in tree_edges(lv).collect()}
    assert got == want


def test_nodes_have_one_id_each_and_give_the_paths_back(spark):
    rows = [("a", "b", "c"), ("a", "b", "c"), ("a", None, "c"), ("a", "", "d"), ("b", "a", "c"), ("ab", "", "c"),
            (None, None, None), ("", "x", "a\u001f")]
    lv = spark.createDataFrame(rows, "l1 string, l2 string, l3 string")
    nodes = tree_nodes(lv)
    got = nodes.collect()
    assert len({(r["level"], bytes(r["node_id"])) for r in got}) == len(got)  # an id is a node's own
    assert all(len(r["node_id"]) == 16 for r in got)
    known = {1: {bytes.fromhex(ROOT_ID)}}
    for r in got:
        known.setdefault(r["level"] + 1, set()).add(bytes(r["node_id"]))
    assert all(bytes(r["parent_id"]) in known[r["level"]] for r in got)
    want = sorted(map(tuple, tree_edges(lv).collect()))
    assert sorted(map(tuple, node_paths(nodes, 3).collect())) == want
    assert tree_nodes(lv.where("false")).count() == 0


def test_nested_document_matches_brute_force(spark):
    lv = _levels(spark)
    rows = [tuple(r) for r in lv.collect()]
    frags = tree_json_fragments(lv).orderBy("path").collect()
    doc = "{" + "".join(f["fragment"] for f in frags) + "}"
    assert json.loads(doc) == _brute(rows)


def test_written_document_and_deep_tree(spark):
    lv = label_rows(view(spark, SF_SMALL, "budget_receipts"), RECEIPT_LEVELS)
    rows = [tuple(r) for r in lv.collect()]
    out = os.path.join(tempfile.mkdtemp(prefix="pw-tree-"), "doc")
    write_tree_json(lv, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p)).read().replace("\n", "") for p in parts)
    assert json.loads(text) == _brute(rows)


def test_columnar_document_matches_brute_force(spark):
    from pursewise.operators.shaping import columnar_json_fragments, write_columnar_json

    covid = view(spark, SF_SMALL, "covid")
    cols = ["department", "funds_sanctioned", "funds_sanctioned_from", "date", "purpose"]
    df = covid.select("row_id", *cols).withColumn("funds_sanctioned", F.col("funds_sanctioned").cast("double"))
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    want = {"records": {c: [(str(r[c]) if c == "date" else r[c]) for r in rows] for c in cols},
            "count": len(rows)}
    frags = columnar_json_fragments(df, cols, "row_id").orderBy("s1", "s2", "s3", "pos").collect()
    assert json.loads("".join(f["fragment"] for f in frags)) == want
    out = os.path.join(tempfile.mkdtemp(prefix="pw-doc-"), "doc")
    write_columnar_json(df, out, cols, "row_id")
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p)).read().replace("\n", "") for p in parts)
    assert json.loads(text) == want
    empty = columnar_json_fragments(df.filter("false"), cols, "row_id").orderBy("s1", "s2", "s3", "pos").collect()
    assert json.loads("".join(f["fragment"] for f in empty)) == {"records": {c: [] for c in cols}, "count": 0}


def test_documents_keep_columns_aligned_under_any_key(spark):
    from pursewise.operators.shaping import columnar_json_fragments, records_json_fragments

    rows = [("o1", "b", 12.0), ("o1", "a", 12.0), (None, "n", None), (None, None, 3.0), ("o2", "c", 1.0), ("o2", "c", 1.0)]
    df = spark.createDataFrame(rows, "ocid string, v string, n double")
    frags = columnar_json_fragments(df, ["v", "n"], "ocid").orderBy("s1", "s2", "s3", "pos").collect()
    doc = json.loads("".join(f["fragment"] for f in frags))
    assert doc["count"] == 6
    pairs = list(zip(doc["records"]["v"], doc["records"]["n"]))
    assert set(pairs[:2]) == {(None, 3.0), ("n", None)} and set(pairs[2:4]) == {("a", 12.0), ("b", 12.0)}
    assert pairs[4:] == [("c", 1.0), ("c", 1.0)]
    frags = records_json_fragments(df, "ocid").orderBy("s1", "pos").collect()
    got = [r["v"] for r in json.loads("".join(f["fragment"] for f in frags))["records"]]
    assert (set(got[:2]), set(got[2:4]), got[4:]) == ({None, "n"}, {"a", "b"}, ["c", "c"])


def test_rows_are_numbered_without_gaps_whatever_the_keys(spark):
    """A key of half the rows and one row repeated 400 times, over several range partitions."""
    from pursewise.operators.shaping import columnar_json_fragments

    rows = [("hot", i % 7) for i in range(400)] + [("same", 1)] * 400 + [(f"k{i:03d}", i) for i in range(100)] + [(None, 0)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    out = columnar_json_fragments(df, ["k", "v"], "k")
    got = out.where("s1 = 1 and s3 = 1 and s2 = 0").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(rows)))
    assert [json.loads(r["fragment"].lstrip(",")) for r in got] == sorted((k for k, _ in rows), key=lambda k: k or "")
    doc = json.loads("".join(f["fragment"] for f in out.orderBy("s1", "s2", "s3", "pos").collect()))
    assert sorted(zip(doc["records"]["k"], doc["records"]["v"]), key=str) == sorted(rows, key=str)


def test_records_document_matches_rows(spark):
    from pursewise.operators.shaping import records_json_fragments

    df = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    frags = records_json_fragments(df, "n_nationkey").orderBy("s1", "pos").collect()
    doc = json.loads("".join(f["fragment"] for f in frags))
    assert doc["count"] == 25 and doc["records"] == [r.asDict() for r in df.orderBy("n_nationkey").collect()]


def test_records_keep_null_fields(spark):
    from pursewise.operators.shaping import records_json_fragments, result_json

    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    frags = records_json_fragments(df, "id").orderBy("s1", "pos").collect()
    assert json.loads("".join(f["fragment"] for f in frags))["records"] == [{"id": 1, "v": None}, {"id": 2, "v": "x"}]
    assert json.loads(result_json(df).orderBy("value").first()["value"]) == {"id": 1, "v": None}


def _shuffled_rows(df, metric="shuffleRecordsWritten") -> int:
    """Rows (or another metric) that the exchanges of ``df`` wrote when it last ran."""
    seen = set()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name.startswith("ReusedExchange"):
            return 0
        own = 0
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            own = node.metrics().get(metric).get().value()
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def _deep(spark):
    names = [f"l{i:02d}" for i in range(1, 10)]
    return spark.range(3000).select(*[(F.col("id") % m).cast("string").alias(n) for n, m in
                                      zip(names, (3, 5, 7, 11, 13, 17, 19, 23, 3000))])


def test_nodes_of_the_deep_levels_are_not_shuffled(spark):
    df = tree_nodes(_deep(spark))
    assert len(df.collect()) > 15000
    assert _shuffled_rows(df) < 9000  # two shuffles of the 3,000 paths, and the short prefixes


def test_document_of_many_levels_shuffles_few_prefixes(spark):
    lv = _deep(spark)
    df = tree_json_fragments(lv)
    got = sorted(map(tuple, df.collect()))
    assert json.loads("{" + "".join(f for _, f in got) + "}") == _brute([tuple(r) for r in lv.collect()])
    assert _shuffled_rows(df) < 12000


def test_paths_are_shuffled_as_plain_texts(spark):
    """A path takes little more than its labels in both shuffles: 20,000 paths of 9 labels of 4 letters."""
    names = [f"l{i:02d}" for i in range(1, 10)]
    lv = spark.range(20000).select(*[F.substring(F.md5(F.concat(F.lit(n), (F.col("id") % m).cast("string"))), 1, 4).alias(n)
                                     for n, m in zip(names, (3, 50, 500, 20000, 20000, 20000, 20000, 20000, 20000))])
    nodes = tree_nodes(lv)
    nodes.collect()
    assert _shuffled_rows(nodes, "shuffleBytesWritten") < 1_760_000  # 1.97 million as lists of labels
    frags = tree_json_fragments(lv)
    frags.collect()
    assert _shuffled_rows(frags, "shuffleBytesWritten") < 1_910_000  # 2.12 million


def test_labels_of_control_characters_keep_their_place_and_order(spark):
    signs = ["", "\u0000", "\u0001", "\u0002", "\u0001\u0001", "\u0001\u0002", "\u0000\u0001", "a", "a\u0000", "a\u0001", "a\u0002", "ab"]
    rows = [(a, b, c, d) for a in signs for b in signs[:6] for c in signs[3:9] for d in (signs[0], signs[5], None)]
    lv = spark.createDataFrame(rows, "l1 string, l2 string, l3 string, l4 string")
    frags = tree_json_fragments(lv).orderBy("path").collect()
    assert json.loads("{" + "".join(f["fragment"] for f in frags) + "}") == _brute(rows)
    labels = [[x or "" for x in r] for r in rows]
    want = {(i + 1, tuple(r[:i]), r[i]) for r in labels for i in range(4)}
    nodes = tree_nodes(lv)
    assert nodes.count() == len(want)
    up = {bytes(r["node_id"]): r for r in nodes.collect()}

    def path(r):
        return () if r["level"] == 1 else (*path(up[bytes(r["parent_id"])]), up[bytes(r["parent_id"])]["label"])

    assert {(r["level"], path(r), r["label"]) for r in up.values()} == want


def test_one_and_two_levels_and_one_path(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("", "x"), ("a", "x")]
    df = spark.createDataFrame(rows, "l1 string, l2 string")
    for lv in (df, df.select("l1"), df.where("l2 = 'y'"), df.where("l2 = 'y'").select("l2")):
        frags = tree_json_fragments(lv).orderBy("path").collect()
        assert json.loads("{" + "".join(f["fragment"] for f in frags) + "}") == _brute([tuple(r) for r in lv.collect()])
        want = sorted(map(tuple, tree_edges(lv).collect()))
        assert sorted(map(tuple, node_paths(tree_nodes(lv), len(lv.columns)).collect())) == want
        assert tree_nodes(lv).count() == len(want)


def test_combinations_with_columns_shuffle_the_columns_only(spark):
    from pursewise.operators.heads import head_combinations

    df = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "a+b"), ("a+b", None)], "x string, y string")
    out = head_combinations(df, ("x", "y"), keep_columns=True)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.distinct().selectExpr("concat_ws('+', x, y) as combination", "x", "y").collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" in plan and "hashpartitioning(combination" not in plan
