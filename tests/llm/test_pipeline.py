"""The pipeline against its stages done by brute force on the rows each was given."""

import hashlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    from framewright.llm import langid, mixing, quality
    from framewright.llm.common import saved

    from .test_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = saved(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        steps.append((before, docs))
    ids = [({r["doc_id"] for r in a.select("doc_id").collect()}, Counter(r["doc_id"] for r in b.select("doc_id").collect())) for a, b in steps]
    judged = langid.predict_language(steps[0][0], langid.fit(steps[0][0])).collect()
    assert set(ids[0][1]) == {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.35}
    scored = quality.score_quality(steps[1][0], quality.fit(steps[1][0], spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert set(ids[1][1]) == {r["doc_id"] for r in scored if r["predicted"] == 1}
    rows = sorted((r["doc_id"], r["text"]) for r in steps[2][0].collect())
    kept = {rows[root][0] for _, root in brute_components([t for _, t in rows], 5)}
    assert set(ids[2][1]) == kept
    assert ids[3][1] == Counter(r["doc_id"] for r in mixing.mix(steps[3][0]).collect())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = Counter()
    for r in docs.collect():
        tokens = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected[r["doc_id"], len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()] += 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in last) == expected


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


ODD = [(None, "un texto sin nombre de los muchos que hay aqui", "es"), (1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "the same words stand in this text and in that one", "en"), (4, "the same words stand in this text and in that one", "en"), (4, "an other text of the same number", "en"), (5, "the same words stand in this text and in that one", "en"), (6, "long " * 40_000, "en"), (7, "x" * 30_000, None)]


def odd_docs(spark, rows=ODD):
    made = [(i, t, lang, "s", len(t or ""), 1, 2) for i, t, lang in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, rep int, block int")


def test_stages_on_odd_rows(spark, monkeypatch):
    from framewright.llm import langid, quality

    monkeypatch.setattr(langid, "fit", lambda docs, **kw: langid.Model(["en", "es"], {k: v * 0 for k, v in langid.initial(2, np.random.default_rng(0)).items()}))
    model = quality.model_of(quality.initial(np.random.default_rng(1)))
    model.prior = 0.3
    monkeypatch.setattr(quality, "fit", lambda *a, **kw: model)
    docs = odd_docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect()))
    judged = stages["language ID"](spark, docs, SF)
    assert judged.columns == docs.columns and ids(judged) == [-1, 4, 4, 4, 5, 6, 7]  # null, empty, blank go
    assert ids(stages["quality classifier"](spark, docs, SF)) == sorted(-1 if i is None else i for i, _, _ in ODD)  # at the threshold
    kept = stages["MinHash near-dedup"](spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == [-1, 1, 2, 3, 4, 6, 7]  # 5 is a copy of 4
    assert kept.where("doc_id = 4").first()["text"].startswith("an other")  # the smallest text of a number
    mixed = stages["mixing sources"](spark, kept, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= {-1, 4, 6, 7}
    last = stages["BPE"](spark, docs, SF).collect()
    assert len(last) == len(ODD) and {r["n_tokens"] for r in last if r["doc_id"] in (1, 2, 3)} == {0}


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_mixing_keeps_documents_without_an_id(spark):
    from framewright.llm import mixing

    rows = [(None, "a b c", "s"), (None, "d e", "s"), (1, "f g h", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(mixing.mixed_documents(docs).collect(), key=lambda r: r["text"])
    assert [(r["doc_id"], r["text"]) for r in found] == [(None, "a b c"), (None, "d e"), (1, "f g h")]
