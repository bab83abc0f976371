"""The stages one after the other, each against a plain version of what it decides on its input."""

import collections
import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import toxicity
from tidemill.llm.common import stored
from tests.llm.test_lines_and_copies import plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test_stage")
        if name != "bpe encoding":
            assert docs.columns == columns
        steps.append(docs.collect())
    before = spark.read.parquet(f"{SF}/documents.parquet")
    clean, lines, unique, mixed, ids = steps
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert {r.doc_id for r in clean} == {r.doc_id for r in before.collect() if scorer.score(r.text) < 0.3}
    assert {(r.doc_id, r.text, r.n_chars) for r in lines} == {(i, t, len(t)) for i, t, _, _ in plain_lines([(r.doc_id, r.text) for r in clean])}
    roots = plain_components(sorted((r.doc_id, plain_fingerprint(r.text, 4)) for r in lines), 4)
    assert sorted(r.doc_id for r in unique) == sorted(set(roots.values()))
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in unique} and max(copies.values()) <= 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert collections.Counter(r.doc_id for r in ids) == copies
    text = {r.doc_id: r.text for r in mixed}
    for row in ids:
        expected = tokenizer.encode(text[row.doc_id], add_special_tokens=False).ids
        assert row.ids == expected and row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
