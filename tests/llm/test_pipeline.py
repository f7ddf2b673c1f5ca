"""The pipeline, stage by stage, against plain Python."""

import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, small):
    import public_tokenizers as P
    import tiktoken

    from evenkeel.llm import bpe, decontaminate, exact, language, simhash
    from evenkeel.llm.common import fold

    read = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    docs = read("documents")
    names = docs.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    # language ID
    from pyspark.sql import functions as F

    model = language.fit_language_model(docs, fold(F.col("id"), 4) != 2)
    ids = sorted(left)
    left = {i: left[i] for i, (_, _, rejected) in zip(ids, model.predict([left[i] or "" for i in ids]), strict=True) if not rejected}
    assert len(left) >= 0.99 * len(ids)  # the documents are prose of four languages
    # exact dedup
    best = {}
    for i, t in sorted(left.items()):
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        if key not in best or len(t) > len(left[best[key]]):
            best[key] = i
    left = {i: left[i] for i in sorted(best.values())}
    # near dedup
    group = simhash.brute_components([(i, simhash.fingerprint(t.encode())) for i, t in left.items()])
    left = {i: t for i, t in left.items() if group[i] == i}
    # decontamination
    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    clean = {}
    for i, t in left.items():
        words, hit, _ = decontaminate.brute_hits(t, items)
        if not (hit and 20 * hit >= words):
            clean[i] = t
    assert clean.keys() < left.keys()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in clean.items():
        got = enc.encode_ordinary(t)
        want.append((i, len(got), hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    rows = pipeline.run(spark, small).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == names, name
    assert exact.drop_exact(docs.where("false")).count() == 0
