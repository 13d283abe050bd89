"""The pipeline stage by stage against plain readings of each stage, and what the registry promises."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import registry
from tests.llm.helpers import DOCS, prose
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_dup import brute as near
from tests.llm.test_packing import check
from tests.llm.test_secrets import base


def folder(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(60)]
    texts += [texts[3], texts[4] + " tail", prose(rng, 20) + " " + item + " " + prose(rng, 20), "my password = hunter2hunter2 " + prose(rng, 40), None, ""]
    junk = ["%%% ### " * rng.randint(10, 60) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < len(texts)), 0) for i in range(len(rows)) if i < 50 or i >= len(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [r[1] for r in rows], item, len(texts)


def test_stages(spark, tmp_path):
    sf, texts, item, n_good = folder(spark, tmp_path)
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name == "best_fit_packing":
            rows = out.collect()
            order = sorted(kept)
            renamed = [{**r.asDict(), "doc_id": order.index(r["doc_id"])} for r in rows]
            check([kept[i] for i in order], renamed)
            break
        assert out.columns == columns
        out.write.parquet(f"{sf}/stage{k}.parquet")
        docs = spark.read.parquet(f"{sf}/stage{k}.parquet")
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_classifier":
            assert sum(i < n_good for i in now) >= n_good - 4 and sum(i >= n_good for i in now) <= 3
        elif name == "minhash_near_dedup":
            order = sorted(kept)
            want = near([kept[i] for i in order], 80)
            assert set(now) == {i for k_, i in enumerate(order) if want[k_][2]}
        elif name == "benchmark_decontamination":
            order = sorted(kept)
            bad = {order[d] for d, _ in contaminated([kept[i] for i in order], [item])}
            assert bad and set(now) == set(kept) - bad
        elif name == "secret_scans":
            assert set(now) == set(kept) and not any(base(t) for t in now.values())
            assert all(now[i] == kept[i] for i in kept if not base(kept[i]) and now[i] is not None and "[SECRET]" not in now[i])
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        kept = now


def test_run_equals_the_stages_and_empty_tables_pass(spark, tmp_path):
    sf, *_ = folder(spark, tmp_path)
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_registry():
    numbers = [int(n.split("_")[0][2:]) for n in registry.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)
