"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    draw = np.random.default_rng(9)
    prose = lambda n=60: " ".join(draw.choice([f"word{k}" for k in range(800)], n)) + "."
    texts = [prose() for _ in range(60)]
    junk = ["BUY!!! " * 20 + f"%%% {k}" for k in range(20)]
    item = " ".join(f"item{k}" for k in range(12))
    planted = [texts[0], texts[1] + " end", prose() + " " + item, prose() + " mail me@x.example.org"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + junk + planted)] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "byte-level BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(60))
    assert clean <= kept["quality classifier"] and not kept["quality classifier"] & set(range(60, 80))
    assert kept["n-gram Jaccard join"] == kept["quality classifier"] - {80, 81}
    assert kept["benchmark decontamination"] == kept["n-gram Jaccard join"] - {82}
    masked = spark.read.parquet(str(tmp_path / "PII")).where("doc_id = 83").first()
    assert masked.text.endswith("mail [EMAIL]") and masked.n_chars == len(masked.text)
    assert kept["byte-level BPE"] == kept["benchmark decontamination"]
    last = spark.read.parquet(str(tmp_path / "byte-level BPE"))
    text = spark.read.parquet(str(tmp_path / "PII")).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    assert last.join(text, "doc_id").where("h <> decoded_sha256").count() == 0
    assert public_tokenizers.PATTERN and last.agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_on_repeated_ids_and_empty_tables(spark, tmp_path):
    """Rows are judged each by its own text, equal rows are one, and an empty table passes through all stages."""
    form = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    item = " ".join(f"item{k}" for k in range(12))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3) + " end"), (4, text(4)), (4, f"{text(5)} {item}"), (None, text(1)), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], form)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    one = sorted((r.doc_id, r.text or "") for r in stages["n-gram Jaccard join"](spark, docs, str(tmp_path)).collect() if r.doc_id)
    assert [x for x in one if x[0] != 3] == sorted([(1, text(1)), (2, text(2)), (4, text(4)), (4, f"{text(5)} {item}"), (5, ""), (5, "")])
    assert len([x for x in one if x[0] == 3]) == 1
    clean = sorted((r.doc_id, r.text or "") for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect() if r.doc_id)
    assert clean == sorted((i, t or "") for i, t in rows if i and item not in (t or ""))
    empty = docs.limit(0)
    for stage in stages.values():
        (empty := stage(spark, empty, str(tmp_path))).collect()
    assert empty.collect() == [] and "n_tokens" in empty.columns
