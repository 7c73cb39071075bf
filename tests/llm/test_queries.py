"""The registered queries and the pipeline over the driver's smallest tables."""

import random

import duckdb
import pytest
from harness import _norm, duck
from llm import brute

import corpus_pipeline
from pursewise.llm import toxicity_chain
from pursewise.llm.common import table
from pursewise.llm.queries import ORACLES, PIECE_BPE, QUERIES, vocabulary
from pursewise.llm.source_mix import SEED

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    out = QUERIES[name](spark, SMALL)
    rel = duck(SMALL).execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(_norm(x) for x in r) for r in rel.fetchall())
    assert sorted(cols) == sorted(out.columns)
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in out.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    rows = QUERIES[name](spark, SMALL).count()
    source = {"op1_nearest": "embeddings", "op3_main_text": "pages"}.get(name, "documents")
    n = duckdb.sql(f"select count(*) from '{SMALL}/{source}.parquet'").fetchall()[0][0]
    if name != "op13_spelling":  # one row a word; compared in test_repeats
        assert rows == (25 * 20 if name == "op1_nearest" else n)


def test_pipeline_matches_brute_force(spark):
    import sentencepiece

    docs = table(spark, SMALL, "documents")
    chain = toxicity_chain.fit(docs, table(spark, SMALL, "labels"))
    toxic = {r.doc_id for r in toxicity_chain.scores(docs, chain).where("rejected").collect()}
    rows = [r for r in sorted(docs.collect(), key=lambda r: r.doc_id) if r.doc_id not in toxic]
    verdict = brute.quality([(r.doc_id, r.source, r.text) for r in rows])
    rows = [r for r, v in zip(rows, verdict) if v["kept"]]
    root, _ = brute.components([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    size = [len(brute.WORD.findall(r.text)) for r in rows]
    took, _ = brute.taken([(r.doc_id, r.source, n, r.text) for r, n in zip(rows, size)], SEED)
    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_BPE))
    want = sorted((r.doc_id, r.lang, r.source, r.n_chars, tuple(sp.encode(r.text)))
                  for r, n, k in zip(rows, size, took) for _ in range(-(-k // n)))
    out = corpus_pipeline.run(spark, SMALL)
    got = out.collect()
    assert all(r.round_trip for r in got)
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.ids)) for r in got) == want


def test_pipeline_drops_boilerplate_lines(spark, tmp_path):
    import sentencepiece

    r = random.Random(9)

    def sentence(n):
        return " ".join("".join(r.choice("abcdelnorst") for _ in range(r.randint(2, 7))) for _ in range(n))

    bar = "home news sport weather travel culture music radio shows more from us here"
    bodies = [sentence(40) for _ in range(36)]
    rows = [(i, f"{bar}\n{b}\n\nshare 12 this" if i % 3 else b, "en", "s0" if i % 3 else "s1") for i, b in enumerate(bodies)]
    rows.append((40, f"{bar}\n{bodies[1]}", "en", "s1"))  # stays whole: another host
    rows.append((41, bodies[2], "en", "s1"))  # equals the rest of document 2
    rows = [(*x[:3], x[3], len(x[1])) for x in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    triples = [(d, s, t) for d, t, _, s, _ in rows]
    texts = [t for t, v in zip(brute.without_boilerplate(triples), brute.quality(triples)) if v["kept"]]
    assert len(texts) == len(rows) and sum(t != x[1] for t, x in zip(texts, rows)) == 24
    root, _ = brute.components(texts)
    assert root[37] == 2
    left = [(d, s, t) for i, ((d, s, _), t) in enumerate(zip(triples, texts)) if root[i] == i]
    size = [len(brute.WORD.findall(t)) for _, _, t in left]
    took, _ = brute.taken([(d, s, n, t) for (d, s, t), n in zip(left, size)], SEED)
    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_BPE))
    want = sorted((d, s, len(t), tuple(sp.encode(t))) for (d, s, t), n, k in zip(left, size, took) for _ in range(-(-k // n)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((g.doc_id, g.source, g.n_chars, tuple(g.ids)) for g in got) == want


def test_stages_of_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
