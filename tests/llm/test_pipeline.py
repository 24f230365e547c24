import importlib

import pytest

import corpus_pipeline
from cashtide.llm.common import table
from cashtide.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_per_operator():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None), (2, ""), (3, "a token = abcdefgh12 here"), (4, "a  token = abcdefgh12 here"), (None, "calm words"), (5, "calm words"), (5, "calm words")]
    folder = str(tmp_path)
    for name, found in (("documents", rows), ("none", [])):
        spark.createDataFrame([(*r, "en", "s", 0) for r in found], schema).write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
    docs = table(spark, f"{folder}/documents", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{folder}/documents")
        assert docs.columns == schema.replace("string", "").replace("long", "").replace(" ", "").split(","), name
    kept = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert kept == {(1, None, None), (4, "a  [secret] here", 16), (5, "calm words", 10)}
    assert corpus_pipeline.run(spark, f"{folder}/documents").select("doc_id").distinct().count() == 3
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


@pytest.fixture(scope="module")
def stages(spark, sample, tmp_path_factory):
    """Inputs and outputs of all stages over the given tables."""
    base, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sample, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sample).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_stages_against_brute_force(stages):
    from .test_exact_dedup import expected
    from .test_near_dedup import brute
    from .test_secrets import plain

    for before, after in stages[:3]:
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = stages[1]
    assert {r.doc_id for r in after} == {i for i, _, _, kept, _ in expected([(r.doc_id, r.text) for r in before]) if kept}
    before, after = stages[2]
    assert {r.doc_id for r in after} == {i for i, _, root in brute([(r.doc_id, r.text) for r in before], 5) if i == root}
    before, after = stages[3]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    texts = {r.doc_id: r.text for r in after}
    assert not any(plain(t) for t in texts.values())
    assert all(r.text == texts[r.doc_id] for r in before if not plain(r.text))
    before, after = stages[4]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_toxicity_stage_keeps_clean(spark, sample, stages):
    labels = {r.doc_id: r.toxic for r in table(spark, sample, "labels").collect()}
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) / len(clean) > 0.95
