"""The pipeline's stages against plain versions, on the smallest tables given."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, seen = rows(docs), [*seen, name]
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for *_, c in brute.shingle_components(before)})
        if name == "substring_dedup":
            old = dict(before)
            want = [(d, t) for d, t, gone in brute.kept_units(before) if not gone or t.strip(" ")]
            assert sorted((d, t or "") for d, t in rows(out)) == sorted(want) and any(t != old[d] for d, t in want)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, *_, bad in brute.contamination(before, items) if not bad)
        if name == "best_fit_packing":
            assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == sorted(brute.token_pieces(before))
        docs = out
    assert seen == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
