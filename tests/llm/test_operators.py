"""Operators against brute force, the public libraries, and their own guarantees."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from pursewise.llm import (ann_crosspolytope, html_text, license_scan, line_quality, minmax_dedup, piece_codec,
                           shard_lookup, source_mix, token_counts, toxicity_chain)
from pursewise.llm.common import components, prepare
from pursewise.llm.queries import PIECE_BPE, WORD_BPE, vocabulary

DOCS = "doc_id long, text string, source string, kept string, n_words string, component_id int"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def sentence(r, lo=3, hi=12):
    return " ".join("".join(r.choice("abcdelnorst") for _ in range(r.randint(2, 7))) for _ in range(r.randint(lo, hi)))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, source): copies, near copies, shared passages, odd and empty texts."""
    r = random.Random(4)
    rows, texts = [], []
    passage = sentence(r, 60, 60)
    for i in range(60):
        texts.append("\n".join(sentence(r) for _ in range(r.randint(1, 8))))
    for t in texts[:12]:
        words = t.split(" ")
        for edits in (1, 3):
            w = list(words)
            for _ in range(edits):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        texts.append(t)
    texts += [passage + " " + sentence(r, 5, 40) for _ in range(8)]
    texts += ["menu home about\n" + sentence(r, 30, 40) for _ in range(14)]
    texts += ["menu home about\nmenu home about"] * 2
    texts += [None, "", " \n\t ", "one two", "One  TWO", "one two", "a b c d e", "x " * 400, "#$ <b> & | " * 3,
              "Permission line\nReleased under the MIT License.\n\nReleased under the  mit license", "É é\x0bß \xa0 z"]
    for i, t in enumerate(texts):
        rows.append((i, t, [None, "s1", "s2", "s0"][i % 4]))
    rows += [rows[3], rows[3], (None, texts[5], "s1"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """The corpus with columns whose names clash with those of the results."""
    return spark.createDataFrame([(d, t, s, "x", "y", 7) for d, t, s in corpus], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def counted(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


# ------------------------------------------------------------------ 1

def _brute_nearest(vectors, queries, k):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and None not in v
          and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            near = sorted((-float((ok[q] * ok[c]).sum()), c) for c in ok if c != q)
            out[q] = [(c, -s) for s, c in near[:k]]
    return out


def test_nearest_matches_brute_force(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(6, 20))
    rows = [(i, (centers[i % 6] + 0.6 * r.normal(size=20)) * r.uniform(0.5, 2)) for i in range(900)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows[7] = (7, [4 * x for x in rows[7][1]])
    rows += [(900 + i, rows[7][1]) for i in range(60)]  # one vector that many rows share
    rows += [(2000, None), (2020, [0.0] * 20), (2040, [float("nan")] * 20), (2060, [1.0, None] * 10),
             (2080, [float("inf")] * 20), (None, rows[3][1]), rows[20], (2100, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = ann_crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    want = _brute_nearest(rows, range(0, 3000, 20), 20)
    assert {g.query_id for g in got} == set(want)
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    hit = sum(len({c for c, _ in found[q]} & {c for c, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
    # the shared vector: its other rows come first, smallest ids first
    assert [c for c, _ in found[900]][:5] == [7, 901, 902, 903, 904]


def test_nearest_with_few_rows(spark):
    frame = spark.createDataFrame([(20 * i, [1.0 * i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = ann_crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert counted(g.query_id for g in got) == {0: 3, 20: 3, 40: 3, 60: 3}
    assert ann_crosspolytope.nearest(frame.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_one_long_row_costs_no_recall(spark):
    x = np.random.default_rng(3).normal(size=(8000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = []
    for longer in (1, 6):
        x[1] *= longer
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        near = ann_crosspolytope.nearest(frame, F.col("vec_id") % 400 == 0, 20, tables=4, probes=4)
        got.append(ann_crosspolytope.recall(frame, near, F.col("vec_id") % 400 == 0))
    assert got[0] > 0.8 and got[1] >= got[0] - 0.02


def test_probes_follow_the_number_of_vectors():
    ranges = ann_crosspolytope.norm_ranges({0: 400_000, 1: 50_000, 2: 3_000}, 64, 1.0, 12, 24)
    assert [(h.tables, m, p) for h, m, p in ranges.values()] == [(12, 1.0, 48), (12, 0.5, 24), (1, 0.0, 24)]


def test_vectors_of_any_finite_size_take_part(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)]
    rows += [(400, [1e-200, 2e-200, 0.0, 0.0, 0.0, 1e-200]), (420, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0]), (440, [1e200, -2e200, 0.0, 1e200, 0.0, 0.0]),
             (460, [-1e200, 2e200, 1e200, 0.0, 0.0, 0.0]), (461, [1.7e308] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    with np.errstate(over="ignore", invalid="ignore"):
        ok = {i: np.array(v) for i, v in rows}
        want = {}
        for q in range(0, 480, 20):
            if q in ok:
                scores = {c: float((ok[q] * ok[c]).sum()) for c in ok if c != q}
                scores = {c: -math.inf if math.isnan(x) else x for c, x in scores.items()}
                want[q] = sorted(((-x, c) for c, x in scores.items()))[:20]
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        found.setdefault(g.query_id, []).append((-g.score, g.vec_id))
    assert set(found) == set(want) and all(len(x) == 20 for x in found.values())
    hit = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hit >= 0.9 * 20 * len(want), hit / len(want)
    # the long vectors lead wherever they are near, with their exact products
    assert all({c for _, c in want[q] if c in (440, 460, 461)} <= {c for _, c in found[q]} for q in want)


def test_two_dimensions_and_an_id_with_two_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.normal(size=4 if i % 3 else 7)]) for i in range(120)]
    frame = spark.createDataFrame(rows + [(40, [0.5] * 4), (60, rows[60][1])], "vec_id long, embedding array<double>")
    got = ann_crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    pack = lambda v: np.array(v, "<f8").tobytes()
    one = dict(rows)
    one[40] = min(one[40], [0.5] * 4, key=pack)  # of two vectors the first in byte order
    for q in range(0, 120, 20):
        same = [(c, v) for c, v in one.items() if len(v) == len(one[q])]
        want = _brute_nearest(same, [q], 20)[q]
        assert [(g.vec_id, round(g.score, 12)) for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q] == [
            (c, round(s, 12)) for c, s in want]


def test_distinct_tied_vectors_go_by_id(spark):
    rows = [(0, [0.0, 1.0])] + [(i, [float(i), 1.0]) for i in range(399, 0, -1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_crosspolytope.nearest(frame, F.col("vec_id") == 0, 20).collect()
    assert [(g.vec_id, g.score) for g in sorted(got, key=lambda g: g["rank"])] == [(i, 1.0) for i in range(1, 21)]


def test_hadamard_rounds_keep_lengths_and_probes_start_at_the_bucket():
    h = ann_crosspolytope.CrossPolytopes(20, 3000, tables=3)
    x = np.random.default_rng(1).normal(size=(50, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = ann_crosspolytope._hadamard(np.hstack([x, np.zeros((50, 12))]))
    assert np.allclose((y * y).sum(axis=1), 1)
    for t in range(3):
        p = h.probes(x, t, 8)
        assert (p[:, 0] == h.codes(x, t)).all() and all(len(set(row)) == 8 for row in p)


# ------------------------------------------------------------------ 2

def test_lookup_table_by_turns():
    shards, size = [f"s{i}" for i in range(5)], 13
    got = shard_lookup.lookup_table(shards, size)
    import hashlib
    prefs = []
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        prefs.append([(a + k * b) % size for k in range(size)])
        assert sorted(prefs[-1]) == list(range(size))
    want = {}
    while len(want) < size:
        for i, p in enumerate(prefs):
            if len(want) < size:
                want[next(x for x in p if x not in want)] = i
    assert [want[s] for s in range(size)] == list(got)
    with pytest.raises(ValueError):
        shard_lookup.lookup_table(shards, 12)
    with pytest.raises(ValueError):
        shard_lookup.lookup_table([], 13)


def test_shards_are_even_and_few_documents_move(spark, docs, none):
    table = shard_lookup.lookup_table(shard_lookup.SHARDS)
    n = np.bincount(table)
    assert n.max() - n.min() <= 1
    rows = shard_lookup.shard_documents(spark.range(20_000).withColumnRenamed("id", "doc_id")).collect()
    moved = [r for r in rows if r.shard != r.shard_without_last]
    last = [r for r in rows if r.shard == shard_lookup.SHARDS[-1]]
    assert all(r.shard_without_last != shard_lookup.SHARDS[-1] for r in rows)
    assert len(moved) < len(last) + 0.05 * len(rows)
    out = shard_lookup.shard_documents(docs)
    assert out.count() == docs.count() and out.where("shard is null or slot is null").count() == 0
    assert shard_lookup.shard_documents(none).count() == 0


# ------------------------------------------------------------------ 3

def test_main_text_of_broken_and_plain_pages(spark):
    tree = html_text.train(*html_text.labelled_blocks())
    long = " ".join(["word"] * 30)
    pages = {
        None: "", "": "", "<html><body></body></html>": "",
        f"<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>{long}<p>short &#8377;\n\t one</p><footer>x</footer></article>"
        "<div class='cookie-notice'>We use cookies on this site for you</div><footer>&copy; me</footer>":
            f"T & t\n\n{long}\n\nshort ₹ one",
        f"<header>Site name</header><main><header><h1>Head</h1></header><p>{long}</p></main><aside><p>{long}</p></aside>"
        f"<section id=comments><p>{long}</p></section><form>Your name <input></form>": f"Head\n\n{long}",
        f"<script>var a = '<p>no</p>';</script><style>p{{}}</style><article><p>a<br>b</p><p>{long}</p><div class=ad>Buy</div></article><p cla":
            f"a b\n\n{long}",
        f"<article><p>{long}</p><p>cut off &am": f"{long}\n\ncut off &am",
    }
    rows = [(i, "u", h, "x") for i, h in enumerate(pages)] + [(None, None, None, "x"), (0, "u", None, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by_id = {r.page_id: r for r in got.collect()}
    for i, want in enumerate(pages.values()):
        assert by_id[i].text == want and by_id[i].n_chars == len(want)
    assert got.count() == len(rows) and html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    x, y = html_text.labelled_blocks(200, seed=5)  # held out
    assert (html_text.is_content(tree, x) == y).mean() > 0.95
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert isinstance(html_text.main_text(deep + f"<article><p>{long}</p></article>", tree), str)


def test_main_text_where_names_and_end_tags_say_nothing():
    tree = html_text.train(*html_text.labelled_blocks())
    long = " ".join(["word"] * 40)
    for page, want in {
        f"<button>Menu<article><p>{long}</p><p>Short.</p></article>": f"{long}\n\nShort.",
        f"<article><p>{long}</p><select><option>a<option>b<p>Second words here.</p></article>": f"{long}\n\nSecond words here.",
        f"<article><div><button>Open</div><p>{long}</p></article>": long,
        f"<article><button>One<div>Two</div></button><noscript><p>Enable it</p></noscript><p>{long}</p></article>": long,
        f"<article><h1>T</h1><h2 id='share-prices'>Share prices</h2><p>{long}</p><h2 id='related-work'>Related</h2><p id='tags'>Tags text.</p></article>":
            f"T\n\nShare prices\n\n{long}\n\nRelated\n\nTags text.",
        f"<article><p>{long}</p><section id='share-prices'><p>They rose.</p></section><div id='comments-list'><p>Nice!</p></div></article>": f"{long}\n\nThey rose.",
        f"<body><div><h1>A title of it</h1><p>{long}</p><p>Short one.</p><p>{long}</p></div><footer>x</footer></body>": f"A title of it\n\n{long}\n\nShort one.\n\n{long}",
        f"<body><div><p>{long}</p><p>{long}</p></div><div class='box7'><p>Get our news by mail.</p><input name=e><button>Go</button></div></body>": f"{long}\n\n{long}",
        f"<article><p>{long}</p><div class='box7'><p>Get our news by mail.</p><input name=e></div><p>{long}</p></article>": f"{long}\n\n{long}",
        "<nav><a href=x>H</a></nav><article><p>a</p></article><footer>c</footer>": "a",
        f"<article><h2><a href=x>Title link</a></h2><p>{long}</p></article>": f"Title link\n\n{long}",
    }.items():
        assert html_text.main_text(page, tree) == want, page


def test_main_text_tree_reads_the_neighbours(spark, corpus):
    """Shuffled neighbour figures must cost accuracy on pages whose names say nothing."""
    tree = html_text.train(*html_text.labelled_blocks())

    def used(t):
        return set() if isinstance(t, bool) else {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"words", "links"} <= used(tree)
    assert any(f.startswith("words_") for f in used(tree)) and any(f.startswith("links_") for f in used(tree))
    plain = [html_text.parsed(p) for p in html_text.labelled_pages(200, seed=5)[1::2]]
    x = np.vstack([html_text.features(p)[~html_text.named_furniture(p)] for p in plain])
    y = np.array([m == "content" for p in plain for m, out in zip(p.marks, html_text.named_furniture(p)) if not out])
    mixed = x.copy()
    mixed[:, 2:10] = np.random.default_rng(1).permutation(x[:, 2:10])
    right = (html_text.is_content(tree, x) == y).mean()
    assert right > 0.95 and (html_text.is_content(tree, mixed) == y).mean() < right - 0.01


def test_main_text_matches_brute_force():
    """Well-formed pages: a plain scan of the tags, figures by loops, the tree walked block by block."""
    tree = html_text.train(*html_text.labelled_blocks())
    for page in html_text.labelled_pages(80, seed=23):
        assert html_text.main_text(page, tree) == brute.main_text(page, tree, html_text), page


# ------------------------------------------------------------------ 4

def test_near_duplicates_match_brute_force(spark, corpus, docs, none):
    got = minmax_dedup.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    root, n = brute.components([t for _, t, _ in corpus])
    ids = {}
    for (d, _, _), x in zip(corpus, root):
        if d is not None:
            ids[x] = min(ids.get(x, d), d)
    want = [(d, n[i], ids.get(root[i], d) if n[i] else d) for i, (d, _, _) in enumerate(corpus)]
    want = [(*w, w[0] == w[2]) for w in want]
    assert counted(map(tuple, got.collect())) == counted(want)
    assert minmax_dedup.near_duplicates(none).count() == 0 and minmax_dedup.distinct_documents(none).count() == 0


def test_one_document_of_each_group_stays(corpus, docs):
    out = minmax_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    root, n = brute.components([t for _, t, _ in corpus])
    groups = {root[i] if n[i] else ("empty", d, t) for i, (d, t, _) in enumerate(corpus)}
    rows = out.collect()
    assert len(rows) == len(groups)
    first = {}
    for i, (d, t, _) in enumerate(corpus):
        g = root[i] if n[i] else ("empty", d, t)
        if d is not None:
            first[g] = min(first.get(g, d), d)
    assert {r.doc_id for r in rows if r.doc_id is not None} == set(first.values())


def test_buckets_in_blocks_lose_no_link(spark, corpus, docs, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "BLOCK", 3)
    monkeypatch.setattr(minmax_dedup, "PER_SALT", 2)
    a = counted(map(tuple, minmax_dedup.near_duplicates(docs).collect()))
    monkeypatch.undo()
    assert a == counted(map(tuple, minmax_dedup.near_duplicates(docs).collect()))


def test_min_max_estimates_similarity():
    r = np.random.default_rng(3)
    both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = (minmax_dedup.min_max(np.unique(np.concatenate([both, z]))) for z in (a, b))
    assert abs((x == y).mean() - 600 / 800) < 0.13


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    want = {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert got == want


# ------------------------------------------------------------------ 5

def _encoder(**kw):
    return token_counts.Encoder(vocabulary(WORD_BPE).decode(), **kw)


def test_token_counts_match_the_library(corpus, docs, none):
    e = _encoder()
    want = {}
    for d, t, _ in corpus:
        k = (d, len((t or "").encode()), len(e.tok.encode(t or "", add_special_tokens=False).ids))
        want[k] = want.get(k, 0) + 1
    out = token_counts.token_counts(docs, vocabulary(WORD_BPE).decode())
    assert counted((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()) == want
    assert out.where("over_limit <> (n_tokens > 2048)").count() == 0
    assert token_counts.token_counts(none, vocabulary(WORD_BPE).decode()).count() == 0


def test_resynchronised_chunks_match_the_whole_text():
    e = _encoder(chunk=64, overlap=4)
    r = random.Random(8)
    parts = ["a", "word ", "é", "é", "́", "<|endoftext|>", "<|endof", "text|>", "'s", " 's", "日本", "12", "  ", "\n",
             "!!", "...", "Σ", "İ", "\xa0", "ﬁ", "z" * 70, "\x1c", " ", "Ab", "’"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(20, 200))) for _ in range(400)]
    texts += ["a" * 1000, "ab" * 500 + " c", "!" * 300, "́" * 300, "<|endoftext|>" * 50, " " * 500]
    assert any(len(t) > 640 for t in texts)
    for t in texts:
        assert e.counts([t]) == [len(e.tok.encode(t, add_special_tokens=False).ids)], t


# ------------------------------------------------------------------ 6

def test_licenses_match_brute_force(spark, corpus, none):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(d, t) for d, t, _ in corpus] + [(900, "Copyright me\n\n" + mit.replace("\n", " ") + "\n\nend"), (901, mit.upper()),
                                             (902, mit.replace("software", "program")), (903, "All rights reserved. " * 50)]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {}
    for d, t in set(rows):
        for k, v in brute.dice(t or "", license_scan.TEMPLATES, license_scan.MIN_DICE).items():
            want[(d, k)] = v
    assert {(r.doc_id, r.license_id): (r.dice, r.n_units) for r in got.collect()} == want
    assert any(k == (901, "MIT") for k in want) and license_scan.licenses(none).count() == 0


# ------------------------------------------------------------------ 7

def test_mix_matches_brute_force(corpus, docs, none):
    rows = [(d, s, len(brute.WORD.findall(t or "")), t) for d, t, s in corpus]
    took, goal = brute.taken(rows, source_mix.SEED)
    got = source_mix.mixed_sizes(docs).collect()
    assert counted((r.doc_id, r.size, r.taken) for r in got) == counted((d, n, k) for (d, _, n, _), k in zip(rows, took))
    for r in got:
        assert r.taken <= 3 * r.size and any(math.isclose(r.target, g, rel_tol=1e-12) for g in goal.values())
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) <= 10 * len(goal)
    assert source_mix.mixed_sizes(none).count() == 0 and source_mix.mixed_documents(none).count() == 0


MIX = {"a": 1_400_000, "b": 90_000, "c": 30_000, None: 7_000}  # more words than slots: blocks of two


def test_schedule_spreads_each_source_evenly(spark):
    per = source_mix.sources(spark.createDataFrame(list(MIX.items()), "source string, size long"))
    plan = sorted((r.slot, r.source, r["rank"]) for r in source_mix.schedule(per).collect())
    rows = {r.source: r for r in per.collect()}
    want = brute.targets(MIX)
    assert {s: round(r.target, 6) for s, r in rows.items()} == {s: round(t, 6) for s, t in want.items()}
    assert [t for t, _, _ in plan] == list(range(rows["a"].slots)) and rows["a"].block == 2
    quotas = {s: min(math.floor(t + 0.5), 3 * MIX[s]) for s, t in want.items()}
    assert [s for _, s, _ in plan] == brute.drawn_slots(quotas, len(plan))
    for s, r in rows.items():
        mine = [k for _, x, k in plan if x == s]
        assert mine == list(range(len(mine))) and abs(2 * len(mine) - want[s]) <= 16
    for upto in (len(plan) // 4, len(plan) // 2):
        for s, t in want.items():
            assert abs(sum(x == s for _, x, _ in plan[:upto]) - upto * t / sum(want.values())) <= 8


def test_the_schedule_decides_what_is_taken(docs, monkeypatch):
    """With the grid read from its start instead of by reversed bits the last source gets less."""
    drawn = counted((r.doc_id, r.size, r.taken) for r in source_mix.mixed_sizes(docs).collect())
    order = [r.doc_id for r in source_mix.mixed_documents(docs).collect()]

    def plain(per):
        at = per.where("n_slots > 0").select("source", "first_slot", "slots", F.explode(
            F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n_slots") - 1)).alias("slot"))
        return at.where("slot < slots").select("slot", "source", (F.col("slot") - F.col("first_slot")).alias("rank"))

    monkeypatch.setattr(source_mix, "schedule", plain)
    assert counted((r.doc_id, r.size, r.taken) for r in source_mix.mixed_sizes(docs).collect()) != drawn
    assert [r.doc_id for r in source_mix.mixed_documents(docs).collect()] != order


def test_mixture_fills_every_drawn_slot_with_one_block(docs):
    parts = source_mix.mixture(docs).collect()
    words, rank = {}, {}
    for r in parts:
        words[r.slot] = words.get(r.slot, 0) + r.words
        rank.setdefault(r.source, {})[r.slot] = r.block
    assert set(words.values()) == {1}  # a small mix: a slot is one word
    for blocks in rank.values():
        assert [blocks[t] for t in sorted(blocks)] == list(range(len(blocks)))


def test_mix_of_a_very_long_text_and_clashing_names(spark):
    names = ("size", "key", "slot", "times", "n", "words", "doc", "copy", "ts", "tk", "slots", "__size", "__times", "__d")
    rows = [(1, "w " * 300_000, "a"), (2, "x y", "a"), (2, "x y", "a"), (2, "z", "b"), (None, "q r s", None), (None, None, "b"), (5, "", "b")]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows],
                                 "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    took, _ = brute.taken([(d, s, len(brute.WORD.findall(t or "")), t) for d, t, s in rows], source_mix.SEED)
    got = source_mix.mixed_sizes(wide)
    assert sorted((r.size, r.taken) for r in got.collect()) == sorted((len(brute.WORD.findall(t or "")), k) for (_, t, _), k in zip(rows, took))
    out = source_mix.mixed_documents(wide)
    assert out.columns == wide.columns
    want = sum(-(-k // len(t.split())) for (d, t, _), k in zip(rows, took) if t and d != 2)
    assert out.where("doc_id <> 2 or doc_id is null").count() == want


def test_mixed_documents_repeat_whole_rows(docs):
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    sizes = {(r.doc_id, r.size): -(-r.taken // r.size) for r in source_mix.mixed_sizes(docs).collect() if r.size and r.doc_id != 3}
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    got = {(r.doc_id, r.n): r["count"] for r in out.where("doc_id <> 3 or doc_id is null").groupBy("doc_id", size.alias("n")).count().collect()}
    assert got == {k: v for k, v in sizes.items() if v}


# ------------------------------------------------------------------ 8

def _toxic_corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(r, 20, 200).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 2)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "stupid!", "MORON", "qzwy" + sentence(r, 1, 1)[:3], "pathetic"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_chain_finds_held_out_toxic_documents(spark, none):
    train, test = _toxic_corpus(1500, 1), _toxic_corpus(400, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in train] + [(None, 1, 1), (5, 1, None), (99_999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    chain = toxicity_chain.fit(docs, labels)
    held = spark.createDataFrame([(i, t) for i, t, _ in test] + [(None, None), (7000, ""), (7001, "calm " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in toxicity_chain.scores(held, chain).collect()}
    assert sum(got[i] == bool(y) for i, _, y in test) >= 0.97 * len(test)
    assert got[None] is False and got[7000] is False and got[7001] is False
    kept = toxicity_chain.clean_documents(held.withColumn("rejected", F.lit("own")), chain)
    assert kept.columns == ["doc_id", "text", "rejected"]
    assert {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if not x}
    again = toxicity_chain.fit(docs.repartition(7), labels)
    assert [w.tolist() for w in again.weights] == [w.tolist() for w in chain.weights] and again.lexicon == chain.lexicon


def test_chain_without_labels_rejects_nothing(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for d in (docs, none):
        out = toxicity_chain.scores(d, toxicity_chain.fit(d, labels))
        assert out.count() == d.count() and out.where("rejected").count() == 0


def test_models_later_in_the_chain_read_earlier_probabilities():
    chain = toxicity_chain.Chain({}, [np.array([1.0, 0, 0]), np.array([0, 0, 5.0, 0]), np.array([0, 0, 0, 9.0, -4])])
    p = chain.probabilities(np.array([[3.0, 0, 0, 0, 0, 0], [-3.0, 0, 0, 0, 0, 0]]))
    assert p[0, 1] > p[1, 1] and p[0, 2] > p[1, 2]


# ------------------------------------------------------------------ 9

def test_quality_matches_brute_force(corpus, docs, none):
    got = line_quality.quality(docs)
    want = brute.quality([(d, s, t) for d, t, s in corpus])
    cols = got.columns[1:]
    assert counted(map(tuple, got.collect())) == counted((d, *(w[c] for c in cols)) for (d, _, _), w in zip(corpus, want))
    kept = line_quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert counted((r.doc_id, r.text) for r in kept.collect()) == counted(
        (d, t) for (d, t, _), w in zip(corpus, want) if w["kept"])
    assert line_quality.quality(none).count() == 0 and line_quality.kept_documents(none).count() == 0


def test_boilerplate_lines_deplete_documents(spark):
    r = random.Random(6)
    nav = "home news sport weather travel culture music radio shows more from us here"
    rows = [(i, f"{nav}\n{sentence(r, 30, 30)}", "h") for i in range(20)] + [(50, f"{nav}\n{nav.upper()} ", "h"), (51, nav, "other")]
    out = {x.doc_id: x for x in line_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].n_removed_words == 13 and out[0].kept and out[50].n_removed_words == 26 and not out[50].kept and out[51].kept


def test_kept_documents_lose_their_boilerplate_lines(spark):
    r = random.Random(7)
    nav, foot = "Home  news 24 sport", "share this page with a friend"
    rows = [(i, f"{nav}\n\n{sentence(r, 30, 30)}\n{foot if i % 2 else sentence(r)}\n\n{sentence(r)}\n", ["h", None][i % 2]) for i in range(60)]
    rows += [(70, f"{nav}\n\n{nav.upper()} \n{sentence(r, 30, 30)}\nhome news 99 sport", "h"), (71, f"{nav}\n{sentence(r, 30, 30)}", "other"),
             (72, "\n".join([nav] * 9 + [sentence(r, 10, 10)]), "h"), (73, None, "h"), rows[0], rows[1], (None, rows[2][1], "h")]
    frame = spark.createDataFrame([(d, t, s, len(t or ""), "x") for d, t, s in rows], "doc_id long, text string, source string, n_chars int, gone string")
    out = line_quality.kept_documents(frame)
    assert out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType and out.columns == frame.columns
    triples = [(d, s, t) for d, t, s in rows]
    want = [(d, c, s, len(c), "x") for (d, s, _), c, v in zip(triples, brute.without_boilerplate(triples), brute.quality(triples)) if v["kept"]]
    assert counted(map(tuple, out.collect())) == counted(want)
    texts = {d: t for d, t, *_ in want}
    assert nav not in texts[0] and texts[1].count(foot) == 0 and nav in texts[71] and 72 not in texts


# ------------------------------------------------------------------ 10

def test_pieces_match_the_library(corpus, docs, none):
    import sentencepiece

    model = vocabulary(PIECE_BPE)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = piece_codec.PieceCodec(model)
    r = random.Random(1)
    texts = ["".join(r.choice(" ▁  abcdeth\n\tañé日本😀xyz.,!0123'\"_-$   ") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += [t for _, t, _ in corpus if t] + ["word " * 30_000, "z" * 5000, "the." * 2000]
    for t, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == sp.encode(t), t
        assert codec.decode(ids.tolist()) == t.replace("▁", " ")
    out = piece_codec.encoded(docs, model)
    assert out.where("not round_trip or n_ids <> size(ids)").count() == 0 and out.count() == docs.count()
    back = piece_codec.decoded(out, model).select("doc_id", "text").collect()
    assert counted(map(tuple, back)) == counted((d, (t or "").replace("▁", " ")) for d, t, _ in corpus)
    assert piece_codec.encoded(none, model).count() == 0


def test_unigram_words_get_their_best_path():
    r = random.Random(5)
    vocab = {c: -r.uniform(3, 6) for c in "▁abc"}
    vocab |= {"".join(r.choice("▁abc") for _ in range(r.randint(2, 4))): -r.uniform(1, 8) for _ in range(25)}
    codec = piece_codec.PieceCodec(b"", unigram=vocab)

    def best(word):
        if not word:
            return 0.0
        return max(vocab[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in vocab)

    words = ["▁" + "".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(200)]
    for w, ids in codec.encode_words(words).items():
        pieces = [codec.piece[i] for i in np.frombuffer(ids, "<i4")]
        assert "".join(pieces) == w and math.isclose(sum(vocab[p] for p in pieces), best(w))


def test_a_line_limit_does_not_grow_with_the_host(spark):
    r = random.Random(8)
    nav = "home news sport weather travel"
    rows = [(i, f"{nav}\n{sentence(r, 30, 30)}" if i < 11 else sentence(r, 30, 30), "h") for i in range(400)]
    rows += [(1000 + i, f"{nav}\n{sentence(r, 30, 30)}", "ten") for i in range(10)]
    out = {x.doc_id: x.n_removed_words for x in
           line_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {out[i] for i in range(11)} == {5} and {v for k, v in out.items() if k > 10} == {0}


def test_filtering_stages_carry_columns_of_any_name(spark):
    names = ("__hash", "__k", "__d", "__nth", "__words", "__hit", "hash", "d", "k", "nth", "t", "h", "gone", "removed", "left",
             "hit", "counts", "doc", "line", "host", "row_hash", "root", "cls", "n_shingles", "n_words", "a.b")
    r = random.Random(9)
    same, nav = sentence(r, 30, 30), "home news sport weather travel"
    rows = [(i, f"{nav}\n{sentence(r, 30, 30)}", "h") for i in range(12)] + [(20, same, "h"), (21, same, "g"), (22, None, None), (None, "", "g")]
    rows.append((30, "\n".join(sentence(r, 200, 200) for _ in range(500)), "h"))  # a very long text
    wide = spark.createDataFrame([(*row, *range(len(names))) for row in rows],
                                 "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    kept, first = line_quality.kept_documents(wide), minmax_dedup.distinct_documents(wide)
    assert kept.columns == first.columns == wide.columns
    kept, first = kept.collect(), first.collect()
    assert sorted(x.doc_id for x in kept) == [*range(12), 20, 21, 30] and all(x[3:] == tuple(range(len(names))) for x in kept + first)
    assert all(nav not in x.text for x in kept)
    assert sorted(x.doc_id for x in first if x.doc_id is not None) == [*range(12), 20, 22, 30]
    assert {x.text for x in kept if x.doc_id == 30} == {rows[-1][1]} == {x.text for x in first if x.doc_id == 30}


def test_decoding_joins_pieces_and_bytes_in_one_pass():
    from pursewise.llm.piece_codec import PieceCodec

    codec = object.__new__(PieceCodec)
    codec.raw = ["▁a".encode(), b"\xe2", b"\x82", b"\xac", "é".encode(), b"\n"]
    assert codec.decode([0, 1, 2, 3, 4, 5]) == "a€é\n"
    assert codec.decode([1, 2, 0, 3, 4]) == "\ufffd a\ufffdé"
    assert codec.decode([]) == ""
