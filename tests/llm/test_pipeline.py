import corpus_pipeline
from strikeloom.llm import pii


def test_stages(spark, sf, documents):
    docs, names = documents, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    before = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.shared(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        before[name] = docs.count()
    assert documents.count() >= before["toxicity"] > before["near_duplicates"] == before["personal_data"] > 0
    assert not any(pii.base_spans(r["text"]) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_rejected_documents_go(spark, documents):
    """One word marks the toxic documents of labels that are written for this test."""
    import tempfile
    sf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    documents.selectExpr("doc_id", "cast(text like '%the%' as int) as toxic").write.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, sf).collect()}
    bad = {r["doc_id"] for r in documents.where("text like '% the %'").collect()}
    assert len(kept & bad) < 0.1 * len(bad) and len(kept) > 0.2 * documents.count()


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= 3 * df.count()
        assert corpus_pipeline.pack(spark, df, sf).count() >= df.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_personal_data_takes_one_python_process_a_task(spark, frame, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda labelled: None)
    docs = frame([(1, "write to a.b@example.org now", "a"), (2, None, "a"), (3, "nothing here", None), (None, "call +49 30 1234567", "b")])
    out = corpus_pipeline.mask_personal_data(spark, docs, "")
    assert sum(line.count("MapInArrow ") for line in _plan(out).splitlines()) == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, pii.masked(pii.find(docs.select(corpus_pipeline.COLUMNS), None, keep=corpus_pipeline.COLUMNS)).select(corpus_pipeline.COLUMNS).collect()))


def test_mixing_moves_no_texts(spark, documents):
    plan = _plan(corpus_pipeline.mix_sources(spark, documents, ""))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan
