import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import common, packing, tokenbin, tokens
from weftgraph.llm.tokens import Encoder, public_path

TEXTS = ["Hello world, it's fine.", None, "", " ", "a  b", " lead", "trail ", "x \n y\n\n  z", "don't. x's! 'll", "<|endoftext|> a<|endoftext|>", "über ñandú 12,5 $$$", "long" * 4000, "word " * 3000, "Hello world, it's fine."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab .,'\n\t$1é 　sTl<|endofx>", max_size=40), max_size=6))
def test_encoder_equals_the_library(texts):
    enc = _encoder()
    ids, sizes = enc.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ([x.tolist() for x in enc.whole(texts)] or [[]])
    ids, sizes = enc.encode(texts, 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ([[*x.tolist(), 7] for x in enc.whole(texts)] or [[]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\u2019stmdrevl!x1\n\t\r\u00a0\u0085\u3000\u200b\x1c\u180e\u00b2\u0660\u0301\U0001f600", max_size=30)), max_size=4))
def test_units_equal_the_library(texts):
    test = _encoder()
    ids, sizes = test.encode(texts, 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ([[*x.tolist(), 1] for x in test.whole(texts)] or [[]])


def test_long_texts_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    monkeypatch.setattr(tokens, "KEEP", 40)
    enc = Encoder(public_path())
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = ["".join(rng.choice([" ", "  ", "\n", "a", "don't", "x1", "\u00e9.", " \n", "'s"], rng.integers(0, 300))) for _ in range(3)]
        ids, sizes = enc.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.tolist() for x in enc.whole(texts)]


def test_another_pattern_is_left_to_the_library():
    enc = Encoder(public_path("word_bpe_49k.json"))
    assert not enc.by_units
    ids, sizes = enc.encode(["A  b'S c", ""], 5)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*x.tolist(), 5] for x in enc.whole(["A  b'S c", ""])]


def _encoder(memo=[]):
    if not memo:
        memo.append(Encoder(public_path()))
    return memo[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_stream_of_bytes(values):
    ranks = np.array(values, np.uint32)
    assert tokenbin.unpack(*tokenbin.pack(ranks), len(ranks)).tolist() == values


def test_token_files(spark, tokenizer):
    got = sorted(tokenbin.round_trip(docs(spark, TEXTS)).collect())
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*ids_of(tokenizer, t), 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_decode_alone(spark):
    folder = tokenbin.write(docs(spark, TEXTS))
    got = sorted(tokenbin.read(spark, folder).collect())
    assert [r["doc_id"] for r in got] == list(range(len(TEXTS))) and got[0]["start"] == 0
    ranks = np.frombuffer(tokenbin.read_whole(folder, tokenbin.RANKS), "<u4")
    assert len(set(ranks.tolist())) == len(ranks)
    no_id = tokenbin.round_trip(docs(spark, TEXTS).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))).collect()
    assert sorted(r["start"] for r in no_id) == sorted(set(r["start"] for r in no_id)) and sum(r["doc_id"] is None for r in no_id) == 4


def test_token_files_edges(spark):
    df = docs(spark, TEXTS)
    assert tokenbin.round_trip(df.limit(0)).count() == 0
    both = tokenbin.round_trip(df.unionAll(df)).collect()
    assert len(both) == 2 * len(TEXTS) and len({r["start"] for r in both}) == len(both)


def test_shards_are_coded_in_blocks():
    ranks = np.random.default_rng(2).integers(0, 1 << 17, tokenbin.SHARD_IDS, np.uint32)
    tracemalloc.start()
    control, data = tokenbin.pack(ranks)
    packed, at = tracemalloc.get_traced_memory()[1], tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    got = tokenbin.unpack(control, data, len(ranks))
    unpacked = tracemalloc.get_traced_memory()[1] - at
    tracemalloc.stop()
    assert np.array_equal(got, ranks)
    assert packed < 24 << 20 and unpacked < 16 << 20, (packed, unpacked)


def test_token_files_pass_through_workers_in_small_parts(spark):
    """Arrow batches are bounded by bytes, and the JVM hands on the shards' names alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = tokenbin.round_trip(docs(spark, TEXTS))
    assert int(spark.conf.get(key)) == common.BATCH_BYTES
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == len(TEXTS)
    spark.conf.unset(key)


def test_encoders_go_before_files_are_written_and_read(tmp_path):
    folder = f"file://{tmp_path}"
    tokenbin.write_whole(folder, tokenbin.RANKS, b"")
    for work in (tokenbin._write(iter([]), folder, 2), tokenbin._read(iter([]), folder)):
        tokens.encoder(public_path())
        list(work)
        assert not tokens._encoders


def test_packing(spark, tokenizer):
    rows = packing.pack(docs(spark, TEXTS)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        ids, at = np.array([*ids_of(tokenizer, t), 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(docs(spark, TEXTS).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_balance(sizes):
    out = packing.balance(sizes)
    got, used = [0] * len(sizes), {}
    for item, start, size, s, offset in out:
        assert start == got[item] and offset == used.get(s, 0) and size > 0
        got[item] += size
        used[s] = used.get(s, 0) + size
    assert got == sizes and len(used) == -(-sum(sizes) // 1024) and max(used.values(), default=0) <= 1024


def test_balance_prefers_the_cheapest():
    # the long piece costs more than its tokens, so short ones go to the other sequences first
    out = packing.balance([900, 300, 300, 300, 200], 1024)
    cost = {}
    for _, _, size, s, _ in out:
        cost[s] = cost.get(s, 0) + size + size * size / 1024
    assert len(cost) == 2 and max(cost.values()) < 1.7 * (900 + 900 * 900 / 1024)
