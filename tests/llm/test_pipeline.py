import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weftgraph.llm import bpe, mixing, quality
from weftgraph.llm.common import Cut

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [k for k, _ in p.STAGES]
    assert names == ["quality", "line_dedup", "jaccard", "mix", "bpe"]
    frames = {"": docs}
    current = docs
    for name, stage in p.STAGES:
        current = Cut(stage(spark, current, FOLDER), "test").df
        frames[name] = current
        if name != "bpe":
            assert current.columns == docs.columns
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in frames["quality"].collect()} == kept
    clean, one = frames["line_dedup"], frames["jaccard"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(one) <= ids(clean) <= kept and clean.where("n_chars <> length(text)").count() == 0
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.taken(one).collect() if r.taken}
    got = {}
    for r in frames["mix"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == taken
    ranks = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in frames["mix"].collect()}
    for r in frames["bpe"].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text[r.doc_id])
