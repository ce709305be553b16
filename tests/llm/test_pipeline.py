"""The stages of the corpus pipeline, each against brute force on what the stage before kept."""

import hashlib

import corpus_pipeline
import numpy as np

from tests.llm.test_operators import SCHEMA, brute_groups, brute_lines, distance
from tracelane.llm import decontaminate, language_id


def test_stages(spark, sf, tmp_path, tiktoken_encoding):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = lambda name: [(i, r.text) for i, r in kept[name].items()]

    everything = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(kept["language"]) >= 0.97 * len(everything) and all(kept["language"][i] == everything[i] for i in kept["language"])

    lines = {i: t for i, (_, _, t) in brute_lines(text("language")).items() if t.strip()}
    assert lines == dict(text("lines")) and all(r.n_chars == len(r.text) for r in kept["lines"].values())

    groups = brute_groups(text("lines"))
    assert set(kept["near_copies"]) == {i for i, (_, least) in groups.items() if i == least}

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    low = lambda s: decontaminate.normal(np.frombuffer(s.encode(), np.uint8)).tobytes()
    bodies = {i: low(t) for i, t in text("near_copies")}
    assert not [i for i in kept["benchmark"] if any(low(t) in bodies[i] for t in items)]
    gone = set(kept["near_copies"]) - set(kept["benchmark"])
    assert gone and all(any(low(t) in bodies[i] or distance(low(t), bodies[i]) <= 0.2 * len(low(t)) for t in items) for i in gone)

    for i, r in kept["encoding"].items():
        body = kept["benchmark"][i].text
        assert list(r.token_ids) == tiktoken_encoding.encode_ordinary(body) and r.lossless and r.decoded_sha256 == hashlib.sha256(body.encode()).hexdigest()
    assert set(kept["encoding"]) == set(kept["benchmark"])


def test_run_gives_the_last_stage(spark, tmp_path):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "123")], SCHEMA)
    full = rows.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "CAST(0 AS BIGINT) AS n_chars")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of several words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert language_id.learn(full).languages == []
