
import corpus_pipeline
from regmodel.llm import common, decontaminate, near_dups, pieces, quality, secrets


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5) and "near duplicates" in names
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, data), "test")
        outs[name] = docs
        if name != names[-1]:
            assert docs.columns == columns
    kept = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in outs.items()}
    first = {r.doc_id for r in quality.judge(common.table(spark, data, "documents"), common.table(spark, data, "labels")).where("kept").collect()}
    assert kept["quality rules"] == first and len(first) < before
    second = {r.class_id for r in near_dups.classes(outs["quality rules"]).collect()}
    assert kept["near duplicates"] == second
    third = {r.doc_id for r in decontaminate.find(outs["near duplicates"], common.table(spark, data, "benchmark")).where("NOT contaminated").collect()}
    assert kept["benchmark decontamination"] == third == kept["secret scan"] == kept["sentencepiece"]
    for r in outs["secret scan"].collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or "<secret>" in r.text
    model = pieces.model(pieces.default_model())
    final = {r.doc_id: r.text for r in outs["secret scan"].collect()}
    assert all(model.decode(r.token_ids) == final[r.doc_id] for r in docs.collect())
