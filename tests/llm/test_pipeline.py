import zlib

import numpy as np
import pytest

import brute

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, table, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(folder + "/labels.parquet")
    docs = table.select("doc_id", "text", "lang", "source", "n_chars")
    columns = docs.columns
    before = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    scores, threshold = brute.likelihood_ratios(before, [(r.doc_id, r.quality) for r in labels.collect()], 1 << 16)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(pipeline.queries.vocabulary())
            pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())
            want = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in before.items()}
            at = {}
            for i, start, length, crc in pieces:
                assert start == at.get(i, 0) and crc == zlib.crc32(want[i][start : start + length].tobytes())
                at[i] = start + length
            assert at == {i: len(x) for i, x in want.items()}
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text or "" for r in docs.collect()}
        assert len(now) == docs.count()
        if name == "quality_rules":
            counts = {i: brute.quality_counts(t) for i, t in before.items()}
            assert set(now) == {i for i, (n, _, _, _, again) in counts.items() if n >= 20 and 100 * again <= 30 * n and scores[i] >= threshold}
        if name == "exact_dedup":
            assert len(set(now.values())) == len(now) and set(now.values()) == set(before.values())
        if name == "near_dedup":
            want = brute.near_components(before, 80)
            assert set(now) == {i for i, (_, c) in want.items() if i == c}
        if name == "repeated_passages":
            for i, (raw, gone) in brute.repeats(before, 100).items():
                assert now[i] == bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        before = now


def test_run(spark, table, labels, tmp_path):
    table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    docs = table
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars") if name != "packing" else docs, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())


def test_on_empty_table(spark, empty, labels, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
