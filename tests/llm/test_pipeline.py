"""The pipeline on the small documents: every stage's effect against plain recomputation."""

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

from locusweave.llm import bpe


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = f"{corpus_pipeline.materialize(stage(spark, docs, sf_dir)).inputFiles()[0].rsplit('/', 1)[0]}"
        docs = spark.read.parquet(folder)
        assert docs.columns == first, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] > 0.5 * seen[0]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert len([i for i in bad if i in ids]) <= 0.1 * len(bad)
    ranks = bpe.BytePairs(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in docs.collect():
        tokens = theirs.encode_ordinary(r.text)
        want.add((r.doc_id, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
