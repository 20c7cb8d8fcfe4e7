"""The pipeline on the smallest tables: each stage's decision against the operator's own brute force."""

import hashlib
import os

import public_tokenizers as P

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm import bpe, decontaminate, near_dup, secrets, toxicity

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"), fold=toxicity.held_out())
    left = {r.doc_id: r.text for r in rows if model.score(r.text) < toxicity.THRESHOLD}
    ids = sorted(left)
    sh = {i: near_dup.shingles(left[i].encode()) for i in ids}
    parent = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and (left[i] == left[j] or near_dup.similarity(*sh[i], *sh[j]) >= 0.8):
                a, b = parent[i], parent[j]
                for k in ids:
                    if parent[k] in (a, b):
                        parent[k] = min(a, b)
    left = {i: left[i] for i in ids if parent[i] == i}
    tests = decontaminate.Tests([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    left = {i: t for i, t in left.items() if not decontaminate.judge_shard([t.encode()], tests)[0][1].any()}
    net = secrets.train()
    vocab = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    want = {}
    for i, t in left.items():
        ids_ = vocab.encode([secrets.masked(t, secrets.scan_batch([t], net)[0])])[0][0]
        want[i] = (len(ids_), hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 100 < len(got) < len(rows)
    assert os.path.exists(DIR) and [s for s, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_pipeline_on_edge_cases(spark, tmp_path):
    """Null texts and ids, empty texts, repeated rows and extra columns; then an empty table."""
    import corpus_pipeline

    words = "the of and in to a is that it for on was with as by at from his her they".split()
    prose = lambda k: " ".join(f"{words[(k * 7 + i * (k + 3)) % 20]}{(k * 31 + i) % 97}" for i in range(40))
    rows = [(k, prose(k), "en", "s", 1, f"x{k}") for k in range(12)] + [(20, None, "en", "s", 0, "n"), (21, "", None, None, None, None), (None, prose(40), "en", "s", 1, "i"), (3, prose(3), "en", "s", 1, "again"), (30, prose(5), "en", "s", 1, "copy"), (31, "word " * 60_000, "en", "s", 1, "long")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id for r in got), key=lambda x: (x is None, x))
    assert ids == sorted([*range(12), 3, 20, 21, 31]) + [None]
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (20, 21)) and all(r.n_tokens > 0 for r in got if r.doc_id not in (20, 21))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and "n_tokens" in empty.columns
