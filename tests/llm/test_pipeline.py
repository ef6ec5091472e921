import random
import tracemalloc
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_neardup import brute as near_copies

from weftgraph.llm import common, decontam, langcrf, pii, simhash
from weftgraph.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.schema == documents.schema
        if name == "language_id":
            want = {r["doc_id"] for r in langcrf.identify(before).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.MIN_SCORE}").collect()}
        elif name == "near_dedup":
            rows = before.orderBy("doc_id").collect()  # by brute force, as the stage compares shingles
            want = {rows[i]["doc_id"] for i in set(near_copies([r["text"] for r in rows]))}
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontam.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            want = {r["doc_id"] for r in before.collect()} - hit
            assert hit
        else:
            want = {r["doc_id"] for r in before.collect()}
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if name == "sanitisation":
            assert pii.find(docs).agg({"n_email": "sum"}).first()[0] == 0
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 0
    last = {tuple(r)[:4] for r in docs.collect()}
    assert {tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()} == last


def test_empty(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_language_stage_follows_its_prediction(spark):
    """Rows go by the predicted language and its score, not by whether they hold letters."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r["doc_id"]: r for r in langcrf.identify(df).collect()}
    some = langcrf.keep_identified(df, languages=["de", "fr"], min_score=0.9)
    want = {i for i, r in told.items() if r["lang_pred"] in ("de", "fr") and r["score"] >= 0.9}
    assert {r["doc_id"] for r in some.select("doc_id").collect()} == want and 0 < len(want) < len(told)
    lang = {r["doc_id"]: r["lang"] for r in df.where("length(text) > 200").select("doc_id", "lang").collect()}
    kept = [i for i, r in told.items() if i in lang and r["score"] >= corpus_pipeline.MIN_SCORE]
    assert len(kept) >= 0.99 * len(lang) and sum(told[i]["lang_pred"] == lang[i] for i in kept) >= 0.95 * len(kept)


def test_clashing_columns(spark):
    """Columns named as the operators name their own are carried through."""
    names = ["k", "n", "h", "row", "base", "terms", "key", "node", "uid", "component_id", "__keep", "__rn", "item_id", "_t"]
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns and {tuple(r) for r in got.select(names).distinct().collect()} == {tuple(range(len(names)))}, name
    assert simhash.representatives(wide).columns == wide.columns


def test_language_stage_in_little_memory():
    """What a Python worker takes does not follow the size of a batch of texts."""
    rng, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(40_000)]
    texts = [" ".join(rng.choices(words, k=600)) + "." for _ in range(700)]
    n = 4
    model = {"languages": list("abcd"), "weight": np.random.default_rng(1).normal(0, 0.1, (1 << langcrf.HASH_BITS, n)).astype(np.float32), "lex": np.zeros((n, n)), "trans": np.eye(n), "lexicon": {}}
    batch = pa.record_batch({"text": pa.array([t.encode() for t in texts], pa.binary())})
    shared = type("Shared", (), {"value": model})
    tracemalloc.start()
    kept = sum(b.num_rows for b in langcrf._keep(iter([batch]), shared, None, 0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == 700 and peak < 60 << 20, peak  # 34 MB; 96 by chunks of 2 MB


def test_stages_hand_over_small_batches(spark):
    """By rows alone, 400 long texts are one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 8000).alias("text"))
    few = spark.createDataFrame([(1, "one two three four five six", "en"), (2, "un deux trois quatre cinq", "fr")], "doc_id long, text string, lang string")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes], pa.int64())})

    most = lambda: long.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    spark.conf.unset(key)
    assert most() > 15 << 20
    for name, stage in corpus_pipeline.STAGES:
        if name != "sanitisation":  # which has no Python workers
            spark.conf.unset(key)
            stage(spark, few, SF)
            assert most() <= common.BATCH_BYTES + 50_000, name
    spark.conf.set(key, "1000000")
    corpus_pipeline.pack(spark, few, SF)
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)


def test_worker_gives_memory_back():
    """What a task has freed leaves the process, though a block above it is still in use."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    last, seen = [], []

    def rows():
        held = [b"x" * (50_000 + i) for i in range(2000)]
        last.append(held.pop())
        yield len(held)
        del held
        seen.append(resident())

    assert list(common.trimmed(rows())) == [1999] and seen[0] - resident() > 50 << 20
