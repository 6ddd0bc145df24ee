import hashlib

import corpus_pipeline
from rollcall.llm import bpe, exact, mixing, quality, similar

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema=stage(spark, docs, SF).schema)
        kept[name] = docs
        assert k + 1 == len(names) or docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.judged(first, quality.learned(first, labels)).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["quality_rules"].collect()} == good
    best = {}
    for r in kept["quality_rules"].collect():
        t = exact.normalised(r["text"])
        best[t] = max(best.get(t, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["exact_dedup"].collect()) == sorted(best.values())
    first_of = {}
    for r in similar.grouped(kept["exact_dedup"]).collect():
        first_of[r["root"]] = min(r["doc_id"], first_of.get(r["root"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in kept["simhash_near_dedup"].collect()) == sorted(first_of.values())
    want = {r["doc_id"]: r["taken"] for r in mixing.mixed(kept["simhash_near_dedup"]).collect() if r["taken"]}
    assert {r["doc_id"] for r in kept["mixing"].collect()} == set(want)
    own = bpe.WordBpe(bpe.default_path())
    texts = [(r["doc_id"], r["text"]) for r in kept["mixing"].collect()]
    encoded = sorted((d, hashlib.sha256(ids).hexdigest()) for (d, _), ids in zip(texts, own.encoded([t for _, t in texts])))
    assert encoded == sorted((r["doc_id"], r["ids_sha256"]) for r in kept["bpe"].collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
