import os
from collections import Counter

import corpus_pipeline
from keyloom.llm import common, kneser_ney, mixing, quality_rules, simhash
from keyloom.llm.common import materialize

from .conftest import SF


def test_stages(spark, docs, labels):
    """Each stage against the operator's own result on the stage's input."""
    now, steps = docs, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "packing"]
    for name, decide in (
        ("quality_rules", lambda d: {r.doc_id for r in quality_rules.quality_rules(d, labels).where("kept").collect()}),
        ("quality_classifier", lambda d: {r.doc_id for r in kneser_ney.quality_classifier(d, labels).where("kept").collect()}),
        ("near_dedup", lambda d: {r.component_id for r in simhash.near_duplicates(d).collect()}),
    ):
        after = materialize(steps[name](spark, now, SF), name)
        assert after.columns == docs.columns
        rows = after.collect()
        assert {r.doc_id for r in rows} == decide(now) and len(rows) == len({r.doc_id for r in rows})
        assert {tuple(r) for r in rows} <= {tuple(r) for r in now.collect()}
        now = after
    mix = {r.doc_id: r for r in mixing.mix_sources(now).collect()}
    mixed = materialize(steps["mixing"](spark, now, SF), "mixing")
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[k] == int(r.taken / r.size + 0.5) for k, r in mix.items() if r.size)
    pieces = steps["packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == copies
    assert len(pieces) == corpus_pipeline.run(spark, SF).count()


def test_odd_documents(spark, odd_docs):
    """Nulls in every column, repeated rows and clashing names pass all stages."""
    now = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, now, SF), name)
        assert after.columns == odd_docs.columns
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in now.collect()}
        now = after
    assert now.count() > 0 and now.where("text is null or text = ''").count() == 0
    pieces = corpus_pipeline.packing_stage(spark, now, SF)
    assert pieces.agg({"length": "sum"}).first()[0] > 0


def test_empty_tables(spark, tmp_path, no_docs, labels):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, some in (("none", labels.limit(0)), ("some", labels)):
        some.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0, name


def test_clean_up(spark, docs, labels):
    common.clean_up(spark)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    mine = [p.removeprefix("file:").replace("//", "/") for p in common._written]
    assert any(os.path.basename(p).startswith("mixing") for p in mine) and not any(os.path.basename(p).startswith("near_dedup") and os.path.exists(p) for p in mine)
    common.clean_up(spark)
    assert not common._written and not any(os.path.exists(p) for p in mine)
