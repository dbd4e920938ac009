"""The pipeline's stages against brute-force versions, and what happens without the subpackage."""

import sys
from itertools import combinations
from pathlib import Path

import cases

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from atalaya.llm import quality  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import joined, similar_lines_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.good_documents(spark, docs, SF).cache()
    scored = {r.doc_id: r.predicted for r in quality.op9(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scored.items() if p == 1}
    cut = corpus_pipeline.distinct_lines(spark, good, SF).cache()
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted(similar_lines_kept([(r.doc_id, r.text) for r in good.collect()]))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    single = corpus_pipeline.distinct_documents(spark, cut, SF)
    rows = sorted((r.doc_id, r.text.lower().split()) for r in cut.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, w in rows]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in single.collect()}
    assert kept == {rows[r][0] for r in joined(len(rows), near)} and single.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, single, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= kept


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sorted(r.sequence_id for r in got) == list(range(len(got)))


def test_awkward_rows_pass_every_stage(spark):
    for docs in (cases.awkward(spark), cases.nothing(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert corpus_pipeline.sequences(spark, docs, SF).count() >= 0
