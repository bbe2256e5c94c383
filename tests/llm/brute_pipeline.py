"""The pipeline after its first stage, from the brute-force versions of the other tests."""

import numpy as np
import public_tokenizers
import test_line_dedup
import test_mixing
import test_near_dup
import tiktoken

import corpus_pipeline
from photocat.llm import bpe, line_dedup, mixing


def brute_pipeline(rows):
    cut = {d: t for d, t, _, _ in test_line_dedup.brute(rows, line_dedup.MIN_SITES)}
    rows = [(d, cut[d], lang, source) for d, _, lang, source in rows]
    keep = {d for d, c in test_near_dup.brute([(d, t) for d, t, _, _ in rows]) if d == c}
    rows = [r for r in rows if r[0] in keep]
    times = test_mixing.brute(rows, corpus_pipeline.MIX_PERCENT, corpus_pipeline.MIX_EPOCHS, {"lang": mixing.LANGUAGE_WEIGHTS}, mixing.SEED)
    taken = {d for (d, _, t), _ in times.items() if t}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary_path()).rank, special_tokens={})
    ids = {d: np.array(library.encode_ordinary(t), dtype="<u4").tobytes() for d, t, _, _ in rows if d in taken}
    return {d: (len(x) // 4, x) for d, x in ids.items()}
