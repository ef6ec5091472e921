import math
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import ctw, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, word string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "w") for i, t in enumerate(texts)], DOCS)


TEXTS = ["The cat sat on the mat", "the cat sat on the mat", "a cat", None, "", "  \n\t ", "über Ñandú ÉÉ", "x" * 3000, "word " * 500, "The dog sat on the log and the cat sat on the mat", "the end", "ab ab ab"]


def brute_ctw(train, texts, depth, least):
    """log10 probability by the recursive definition, on dictionaries."""
    counts = defaultdict(lambda: [0, 0])

    def bits(text):
        b = [ctw.PAD] * depth + list(text) + [ctw.END]
        for i in range(depth, len(b)):
            for j in range(8):
                yield b, i, (1 << j) | b[i] >> (8 - j), b[i] >> (7 - j) & 1

    for t in train:
        for b, i, code, bit in bits(t):
            for d in range(depth + 1):
                counts[tuple(b[i - d : i]), code][bit] += 1
    nodes = {k: v for k, v in counts.items() if sum(v) >= least or not k[0]}
    children = defaultdict(list)
    for c, code in nodes:
        if c:
            children[c[1:], code].append((c, code))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def rest(k):
        return [nodes[k][x] - sum(nodes[c][x] for c in children[k]) for x in (0, 1)]

    memo = {}

    def weighted(k):
        if k not in memo:
            own = kt(*nodes[k])
            memo[k] = own if len(k[0]) == depth else math.log(0.5) + np.logaddexp(own, kt(*rest(k)) + sum(weighted(c) for c in children[k]))
        return memo[k]

    def one(b, i, code, d=0):
        k = (tuple(b[i - d : i]), code)
        if k not in nodes:
            return 0.5 if d == 0 else None
        n0, n1 = nodes[k]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return p
        share = math.exp(math.log(0.5) + kt(n0, n1) - weighted(k))
        deeper = one(b, i, code, d + 1)
        if deeper is None:
            r0, r1 = rest(k)
            deeper = (r1 + 0.5) / (r0 + r1 + 1)
        return share * p + (1 - share) * deeper

    out = []
    for t in texts:
        total = 0.0
        for b, i, code, bit in bits(t):
            p = one(b, i, code)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_ctw_against_brute_force(spark):
    texts = TEXTS[:7] + TEXTS[9:]
    got = {r["doc_id"]: r for r in ctw.score(docs(spark, texts)).collect()}
    low = [(t or "").encode().lower() for t in texts]
    train = [t for i, t in enumerate(low) if not ctw.held_out(i, 7, 2)]
    for i, want in enumerate(brute_ctw(train, low, ctw.DEPTH, 2)):
        assert abs(got[i]["score"] - want) < 1e-6 * max(1, abs(want))
    tally = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(tally.values()), len(tally)
    for i, t in enumerate(low):
        w = [*t.split(), b""]
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(tally[x] > 0 for x in w) and got[i]["train_tokens"] == n
        assert abs(got[i]["base_score"] - sum(math.log10((tally[x] + 1) / (n + v + 1)) for x in w)) < 1e-9
        assert got[i]["held_out"] == ctw.held_out(i, 7, 2)


def test_ctw_keeps_contexts_of_any_share(spark):
    """Contexts met twice in over 2**19 bytes count, and grams that aren't broadcast are joined."""
    texts = ["the cat sat " * 44_000, "zebra quartz", "zebra quartz", "zebra quiz jumps", None]
    low = [(t or "").encode() for t in texts]
    ids = [i for i in range(60) if not ctw.held_out(i, 7, 2)][:3] + [i for i in range(60) if ctw.held_out(i, 7, 2)][:2]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(df).collect()}
    few = {r["doc_id"]: r["score"] for r in ctw.score(df, frequent=5).collect()}
    want = brute_ctw(low[:3], low[1:], ctw.DEPTH, 2)
    assert all(abs(got[i] - w) < 1e-6 * abs(w) for i, w in zip(ids[1:], want))
    assert all(abs(got[i] - few[i]) < 1e-9 * abs(got[i]) for i in ids)


def test_ctw_is_a_distribution(spark):
    model = ctw.fit(docs(spark, TEXTS))
    for context in (b"the c", b"\xfe\xfe\xfe\xfe\xfe", b"qzqzq"):
        base = int.from_bytes(context, "big") << 8
        p = 10 ** ctw.evaluate(model["tree"], np.array([base | b for b in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9


def test_ctw_edges(spark):
    df = docs(spark, TEXTS)
    twice = df.unionAll(df)
    assert ctw.score(twice).count() == 2 * len(TEXTS)
    assert ctw.score(df.limit(0)).count() == 0
    no_id = ctw.score(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(no_id) == len(TEXTS) and not any(r["held_out"] for r in no_id)


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    for _ in range(40):
        w = list(rng.choice(vocabulary, 200))
        texts.append(" ".join(w))
        for _ in range(3):
            w[rng.integers(0, 200)] = "edit"
            texts.append(" ".join(w))
    texts += texts[:20]
    fps = [brute_fingerprint(t) for t in texts]
    for bits in (2, 3):
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts), bits).collect()}
        assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
        assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps, bits)


def test_links_in_hot_buckets(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 300:  # one segment alike, so every bucket of it is large
        fps.add(base ^ (int(rng.integers(0, 1 << 12)) << 34))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (2, 3):
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, bits).collect()}
        want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits}
        assert got == want


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}


def test_simhash_edges(spark):
    df = docs(spark, TEXTS)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.representatives(df.unionAll(df)).columns == df.columns
    ids = sorted(r["doc_id"] for r in simhash.representatives(df.unionAll(df)).collect())
    fps = [brute_fingerprint(t) for t in TEXTS]
    assert ids == sorted(set(brute_components(fps, 2)))
