import corpus_pipeline
import pytest

from photocat.llm import bpe, line_dedup, mixing, near_dup, quality
from brute_pipeline import brute_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd):
    docs, _ = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_against_a_version_without_spark(spark, real):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in real[1]]
    judged = {r.doc_id: r.kept for r in quality.judge(real[0]).collect()}
    want = brute_pipeline([r for r in rows if judged[r[0]]])
    got = {r.doc_id: (r.n_tokens, bytes(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("module", [bpe, line_dedup, mixing, near_dup, quality])
def test_modules_state_their_results(module):
    assert "Defined results:" in module.__doc__
