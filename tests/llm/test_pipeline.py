from pyspark.sql import functions as F

import brute
import corpus_pipeline


def test_stages_take_effect(spark, data, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs, kept = documents, [documents]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == documents.columns
        kept.append(docs.cache())
    n = [d.count() for d in kept]
    assert n[0] >= n[1] >= n[2] >= n[3] == n[4] > 0.7 * n[0] and n[2] < n[1]
    texts = [(r["doc_id"], r["text"]) for r in kept[-1].select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not any(v[4] for v in brute.contamination(texts, items).values())
    assert all(brute.secrets(t)[:3] == (0, 0, 0) for _, t in texts)
    rows = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], data).collect()]
    assert brute.check_packing(texts, rows) < 0.02


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_odd_rows_pass_all_stages(spark, odd, labels, data, tmp_path):
    """Nulls, empty and equal texts, repeated rows, ids that texts share, and columns with clashing names."""
    extra = spark.createDataFrame([(40, "a text that shares its id with an other one"), (40, "quite some different words under the very same number"), (None, None)], "doc_id long, text string")
    rows = odd.unionByName(extra, allowMissingColumns=True).withColumns({"__d": F.lit(1), "own_hash": F.lit("h"), "kept_id": F.lit(2), "runs": F.lit("r")})
    folder = f"file://{tmp_path}"
    rows.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == rows.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert [d for d, _ in texts].count(40) == 2 and sum(d in (10, 11) for d, _ in texts) == 1 and sum(not (t or "").strip() for _, t in texts) == 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["start"] == 0 for r in packed) == len(texts)
    (tmp_path / "none").mkdir()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
