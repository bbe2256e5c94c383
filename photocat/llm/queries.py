"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from photocat.llm import bpe, embed_dup, langid, line_dedup, lm, merkle, mixing, near_dup, piecewise, pii, quality, trie, warc

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLE: dict = {}


def _add(fn, sql: str | None = None) -> None:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLE[fn.__name__] = sql


_add(bpe.op4_byte_bpe)
_add(quality.op6_quality_rules)
_add(line_dedup.op8_line_dedup, line_dedup.OP8_SQL)
_add(mixing.op9_mixing, mixing.sql())
_add(near_dup.op10_near_dup)
_add(warc.op5_warc, warc.OP5_SQL)
_add(lm.op3_lm_score)
_add(pii.op1_pii)
_add(embed_dup.op2_embedding_dup, embed_dup.OP2_SQL)
_add(langid.op7_language_id)
_add(piecewise.op11_piecewise_hash)
_add(merkle.op12_merkle, merkle.sql())
_add(trie.op13_prefix_trie, trie.sql())
