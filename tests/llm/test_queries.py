"""The registered queries and the pipeline on a small table."""

import importlib.util
from pathlib import Path

import pytest

from voxloom.llm import queries

COLUMNS = {
    1: {"doc_id", "fingerprint", "component_id"}, 2: {"doc_id", "n_bytes", "n_tokens", "over_limit"}, 3: {"vec_id", "n_links", "component_id", "kept"}, 4: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    5: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, 6: {"doc_id", "n_words", "n_removed", "kept_sha256"}, 7: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    8: {"doc_id", "held_out", "lang_pred", "score"}, 9: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, 10: {"doc_id", "item_id"},
    11: {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}, 12: {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    13: {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    assert set(got.columns) >= COLUMNS[int(name[2:].split("_")[0])]
    assert got.count() > 0


def test_pipeline(spark, sf_dir):
    where = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", where)
    p = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(p)
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
    assert 0.5 * before.count() < docs.count() < before.count()
    assert p.run(spark, sf_dir).select("doc_id").distinct().count() == docs.count()
