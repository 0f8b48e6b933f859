import corpus_pipeline
from gaugework.llm import registry
from gaugework.llm.scratch import Scratch


def test_stages_take_effect(spark, documents, sf_dir):
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Scratch(spark, "test").put(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
            assert docs.where("n_chars <> length(text)").count() == 0
    quality, lines, near = sizes[1:4]
    assert quality < sizes[0] and lines == quality and near < lines and sizes[4] == near
    words = before.selectExpr("sum(size(filter(split(text, '\\\\s+'), w -> w <> ''))) as n").first()["n"]
    assert docs.selectExpr("sum(length) as n").first()["n"] == words


def test_every_operator_is_registered():
    names = sorted(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
