"""LM scoring by context-tree weighting over binary-decomposed bytes.

Training gathers, from every training document, the counts of all byte contexts of
depth 0 to DEPTH and of all words.  Each byte is decomposed into its eight bits; the
bit nodes of a context of depth d are children of those of depth d - 1.  Every node that
training met LEAST times is kept, whatever the corpus' size; one met once joins the rest
child of its parent.  Bottom up, every node weighs its own Krichevsky-Trofimov block
probability against the product over its children; top down, that gives each node one
predictive mixture of the estimates of all depths.  A text's score is the log10 probability
of its lower-cased UTF-8 bytes and an end symbol; code length per byte follows from it.

The tree is never in one place.  Subtrees of contexts of DEALT bytes are weighed where
their grams are dealt; the levels above, which pairs of bytes bound, on the driver.  Each
gram that any text holds is then valued once.  The FREQUENT most common values are
broadcast; those of all other grams are joined to the texts that hold them.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, first_uid, merge_counts, ship, text_bytes

DEPTH = 5
DEALT = 3  # context bytes by which grams are dealt; a pair of bytes may be common
LEAST = 2  # times that training met a node
FREQUENT = 1 << 20  # grams whose values are broadcast
WORD_SHARE = 17
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
CHUNK = 2 << 20
FLUSH = 300_000

_memo: dict = {}


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte) for every byte and end symbol; how many each text has."""
    pad = bytes([PAD]) * DEPTH
    buf = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    wide = buf.astype(np.uint64)
    g = wide.copy()
    for k in range(1, DEPTH + 1):
        g[k:] |= wide[:-k] << np.uint64(8 * k)
    return g[buf != PAD], np.array([len(t) + 1 for t in texts])


def held_out(doc_id, mod: int, rest: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def _count(batches, mod: int, rest: int):
    """Of a partition, partly summed: each gram's counts in training texts (n) and in all
    (seen), each word's in training texts."""
    schema = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("seen", pa.int64())])
    tally: Counter = Counter()
    parts: list = []
    size = 0

    def flush_grams():
        return merge_counts(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def gram_rows(keys, n):
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], schema=schema)

    def word_rows():
        n = pa.array(list(tally.values()), pa.int64())
        return pa.record_batch([pa.nulls(len(tally), pa.int64()), pa.array(list(tally), pa.binary()), n, n], schema=schema)

    for ids, texts in chunks(batches, CHUNK):
        sides: tuple = ([], [])
        for i, t in zip(ids, texts):
            sides[held_out(i, mod, rest)].append(t.lower())
        for t in sides[0]:
            tally.update(t.split())
        if sides[0]:
            tally[b""] += len(sides[0])
        for some, training in zip(sides, (1, 0)):
            if some:
                g, n = np.unique(grams(some)[0], return_counts=True)
                parts.append((g, np.stack([n * training, n], 1)))
                size += len(g)
        if size > 8 * FLUSH:
            merged = flush_grams()
            parts, size = [merged], len(merged[0])
            if size > 4 * FLUSH:
                yield gram_rows(*merged)
                parts, size = [], 0
        if len(tally) > FLUSH:
            yield word_rows()
            tally = Counter()
    if parts:
        yield gram_rows(*flush_grams())
    if tally:
        yield word_rows()


def _dealt(batches):
    """The grams of one partition, sorted, with n and seen."""
    got = [(b.column("gram").to_numpy().view(np.uint64), b.column("n").to_numpy(), b.column("seen").to_numpy()) for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    return merge_counts(np.concatenate([x[0] for x in got]), np.stack([np.concatenate([x[k] for x in got]) for k in (1, 2)], 1))


def bit_nodes(keys: np.ndarray, n: np.ndarray, depths, least: int):
    """By depth: keys of the bit nodes that these grams met `least` times, sorted, zeros, ones."""
    keys, n = keys[n > 0], n[n > 0]
    levels = {}
    for depth in sorted(depths, reverse=True):
        keys, n = merge_counts(keys & np.uint64((1 << 8 * (depth + 1)) - 1), n)
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        found = []
        for j in range(8) if len(keys) else ():
            code = (byte >> np.uint64(8 - j)) | np.uint64(1 << j)
            one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            node = (context << np.uint64(8)) | code
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            n1, both = np.add.reduceat(np.where(one, n, 0), first), np.add.reduceat(n, first)
            keep = both >= least
            found.append((node[first][keep], (both - n1)[keep], n1[keep]))
        node, n0, n1 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.argsort(node)
        levels[depth] = (node[at], n0[at], n1[at])
    return [levels[d] for d in sorted(levels)]


def _upper(batches, least: int):
    """Of one partition of grams, which holds all that share their last DEALT context bytes:
    its share of the counts of the nodes above, and what its own subtrees, which are whole
    here, weigh: the weight, zeros and ones of the children of each node right above."""
    keys, n = _dealt(batches)
    if not len(keys):
        return
    deep = bit_nodes(keys, n[:, 0], range(DEALT, DEPTH + 1), least)
    weighted = upward(deep, DEALT)[0][0]
    for depth, (node, n0, n1) in enumerate(bit_nodes(keys, n[:, 0], range(DEALT), 1)):
        below = np.zeros((3, len(node)))
        if depth == DEALT - 1:
            at = np.searchsorted(node, deep[0][0] & np.uint64((1 << 8 * DEALT) - 1))
            for total, x in zip(below, (weighted, deep[0][1], deep[0][2])):
                np.add.at(total, at, x)
        yield pa.record_batch({"depth": pa.array(np.full(len(node), depth, np.int32)), "node": pa.array(node.view(np.int64)), "n0": pa.array(n0), "n1": pa.array(n1), "w": pa.array(below[0]), "b0": pa.array(below[1]), "b1": pa.array(below[2])})


def _values(batches, shared, least: int):
    """gram, n, seen and the log10 probability of its byte, of one partition as in _upper()."""
    keys, n = _dealt(batches)
    if not len(keys):
        return
    tree, mass, left = shared.value
    deep = bit_nodes(keys, n[:, 0], range(DEALT, DEPTH + 1), least)
    model = tree + downward(deep, DEALT, upward(deep, DEALT), (tree[-1][0], mass, left))[0]
    for a in range(0, len(keys), FLUSH):
        g = keys[a : a + FLUSH]
        yield pa.record_batch({"gram": pa.array(g.view(np.int64)), "seen": pa.array(n[a : a + FLUSH, 1].copy()), "value": pa.array(evaluate(model, g))})


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    lg = lambda x: _lgamma(x).astype(float)
    return lg(n0 + 0.5) + lg(n1 + 0.5) - lg(n0 + n1 + 1.0) - 2 * math.lgamma(0.5)


def _parents(keys: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    return np.searchsorted(above, keys & np.uint64((1 << 8 * depth) - 1))


def upward(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, below=None):
    """Per level, the first at `depth`: log weights, the share of a node's own estimate and
    the rest child's probability of a one.  nodes: per level sorted keys, zeros, ones;
    below: summed weights, zeros and ones of the last level's children (None: leaves)."""
    weighted, own, rest_one = [None] * len(nodes), [None] * len(nodes), [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        keys, n0, n1 = nodes[k]
        kt = log_kt(n0, n1)
        if k < len(nodes) - 1:
            under, at = np.zeros((3, len(keys))), _parents(nodes[k + 1][0], keys, depth + k + 1)
            for total, x in zip(under, (weighted[k + 1], nodes[k + 1][1], nodes[k + 1][2])):
                np.add.at(total, at, x)
        elif below is not None:
            under = below
        else:
            weighted[k], own[k], rest_one[k] = kt, np.ones(len(n0)), np.full(len(n0), 0.5)
            continue
        r0, r1 = n0 - under[1], n1 - under[2]
        weighted[k] = math.log(0.5) + np.logaddexp(kt, under[0] + log_kt(r0, r1))
        own[k] = np.exp(math.log(0.5) + kt - weighted[k])
        rest_one[k] = (r1 + 0.5) / (r0 + r1 + 1)
    return weighted, own, rest_one


def downward(nodes, depth: int, weights, above=None):
    """Per level: node keys and the mixed probability of a one when that node is the deepest
    known; the last level's mass and the share left to what is deeper.  weights: as upward()
    gives them; above: keys, mass and share of the level over the first (None: the root's)."""
    _, own, rest_one = weights
    out = []
    for k, (keys, n0, n1) in enumerate(nodes):
        if above is None:
            before, share = 0.0, 1.0
        else:
            at = _parents(keys, above[0], depth + k)
            before, share = above[1][at], above[2][at]
        mass, left = before + share * own[k] * (n1 + 0.5) / (n0 + n1 + 1), share * (1 - own[k])
        out.append((keys, np.clip(mass + left * rest_one[k], 1e-12, 1 - 1e-12)))
        above = (keys, mass, left)
    return out, above[1], above[2]


def evaluate(model: list, g: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each gram after its context."""
    total, byte = np.zeros(len(g)), g & np.uint64(255)
    limit = np.full(len(g), len(model) - 1)
    for j in range(8):
        code = (byte >> np.uint64(8 - j)) | np.uint64(1 << j)
        p, todo = np.full(len(g), 0.5), np.ones(len(g), bool)
        for d in range(len(model) - 1, -1, -1):
            at = np.flatnonzero(todo & (limit >= d))
            keys, ones = model[d]
            if not len(at) or not len(keys):
                continue
            k = (((g[at] >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | code[at]
            pos = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[pos] == k
            p[at[hit]] = ones[pos[hit]]
            limit[at[hit]] = d
            todo[at[hit]] = False
        limit[todo] = -1
        total += np.log10(np.where((byte >> np.uint64(7 - j)) & np.uint64(1) == 1, p, 1 - p))
    return total


def fit(docs: DataFrame, mod: int = 7, rest: int = 2, least: int = LEAST, frequent: int = FREQUENT) -> dict:
    """Counts over all training documents: the upper levels of the tree, the values of all
    grams of all texts as a DataFrame and of the `frequent` most common in arrays, the words
    that hold at least 1 / 2**WORD_SHARE of all tokens (so at most 2**WORD_SHARE), and the
    counts of all words as a DataFrame."""
    spark = docs.sparkSession
    ship(spark)
    counted = text_bytes(docs).mapInArrow(lambda it: _count(it, mod, rest), "gram long, word binary, n long, seen long")
    counts = cut(counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "ctw-counts")
    word_counts, gram_counts = counts.where("word is not null").select("word", "n"), counts.where("gram is not null").select("gram", "n", "seen")
    tokens, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    dealt = gram_counts.repartition((F.shiftright("gram", 8)).bitwiseAND((1 << 8 * DEALT) - 1))
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "w", "b0", "b1")]
    upper = dealt.mapInArrow(lambda it: _upper(it, least), "depth int, node long, n0 long, n1 long, w double, b0 double, b1 double").groupBy("depth", "node").agg(*sums)
    got = upper.where(f"depth = 0 or n0 + n1 >= {least}").toArrow()
    depth, node = got["depth"].to_numpy(), got["node"].to_numpy().view(np.uint64)
    levels = []
    for d in range(DEALT):
        at = np.flatnonzero(depth == d)
        at = at[np.argsort(node[at])]
        levels.append((node[at], got["n0"].to_numpy()[at], got["n1"].to_numpy()[at]))
    below = [got[c].to_numpy()[at] for c in ("w", "b0", "b1")]
    top = downward(levels, 0, upward(levels, 0, below))
    shared = spark.sparkContext.broadcast(top)
    values = cut(dealt.mapInArrow(lambda it: _values(it, shared, least), "gram long, seen long, value double"), "ctw-values")
    # least count of the grams that are broadcast; of n bytes the counts are at most sqrt(2 n) different ones
    sizes = sorted(zip(*values.groupBy("seen").count().toArrow().to_pydict().values()), reverse=True)
    at_least, held = 1 << 62, 0
    for seen, k in sizes:
        held += k
        if held > frequent:
            break
        at_least = seen
    common = values.where(F.col("seen") >= at_least).select("gram", "value").toArrow()
    keys = common["gram"].to_numpy().view(np.uint64)
    at = np.argsort(keys)
    often_from = max(2, -(-tokens >> WORD_SHARE) if tokens >> WORD_SHARE else 2)
    often = word_counts.where(F.col("n") >= often_from).toArrow()
    return {
        "tree": top[0], "grams": keys[at], "values": common["value"].to_numpy()[at], "rare": values.where(F.col("seen") < at_least).select("gram", "value"),
        "often": dict(zip(often["word"].to_pylist(), often["n"].to_pylist())), "tokens": tokens, "distinct": distinct, "frequent": often_from, "words": word_counts, "mod": mod, "rest": rest,
    }


def known_values(model: dict, g: np.ndarray, lengths: np.ndarray):
    """Per text the summed values of its grams, and its grams that have none here: text,
    gram, how often."""
    met, back = np.unique(g, return_inverse=True)
    keys = model["grams"]
    at = np.minimum(np.searchsorted(keys, met), max(0, len(keys) - 1))
    hit = keys[at] == met if len(keys) else np.zeros(len(met), bool)
    value = np.where(hit, model["values"][at], 0.0) if len(keys) else np.zeros(len(met))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    missed = np.flatnonzero(~hit[back])
    pair, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[missed] * len(met) + back[missed], return_counts=True)
    return np.add.reduceat(value[back], starts), pair // max(1, len(met)), met[pair % max(1, len(met))], times


def _score(batches, shared):
    model = shared.value
    often, norm = model["often"], math.log10(model["tokens"] + model["distinct"] + 1)
    log_of = {w: math.log10(c + 1) - norm for w, c in often.items()} if model["key"] != _memo.get("log_key") else _memo["log_of"]
    _memo.update(log_key=model["key"], log_of=log_of)
    uid = first_uid()
    for ids, texts in chunks(batches, CHUNK):
        lowered = [t.lower() for t in texts]
        g, lengths = grams(lowered)
        scores, owner, gram, times = known_values(model, g, lengths)
        rows: dict = {k: [] for k in ("n_tokens", "base", "known")}
        rare_words, rare_n, rare_at = [], [], [0]
        for t in lowered:
            tally = Counter(t.split())
            tally[b""] = 1
            base, known = 0.0, 0
            for w, k in tally.items():
                x = log_of.get(w)
                if x is None:
                    rare_words.append(w)
                    rare_n.append(k)
                else:
                    base += k * x
                    known += k
            rare_at.append(len(rare_words))
            rows["n_tokens"].append(sum(tally.values()))
            rows["base"].append(base)
            rows["known"].append(known)
        rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64())], ["word", "k"]))
        deep = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(times, pa.int64())], ["gram", "k"]))
        yield pa.record_batch({
            "uid": pa.array(range(uid, uid + len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array([held_out(i, model["mod"], model["rest"]) for i in ids]), "n_bytes": pa.array(lengths - 1, pa.int64()),
            "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "known": pa.array(rows["known"], pa.int64()),
            "base": pa.array(rows["base"], pa.float64()), "score": pa.array(scores, pa.float64()), "rare": rare, "deep": deep,
        })
        uid += len(ids)


def score(docs: DataFrame, mod: int = 7, rest: int = 2, least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """Score every document by a model of those whose crc32(doc_id) mod `mod` isn't `rest`.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.  A null text counts as empty: it has the end
    token alone.  A null doc_id is training data.  Repeated rows are scored each.  An
    empty table gives no rows.  A common word never meets in one task: words above a
    share of the corpus come from the broadcast table, only the rare are joined; grams too.
    """
    spark = docs.sparkSession
    model = fit(docs, mod, rest, least, frequent)
    counts, values = model.pop("words"), model.pop("rare")
    model["key"] = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)
    tokens, distinct = model["tokens"], model["distinct"]
    scored = cut(text_bytes(docs).mapInArrow(
        lambda it: _score(it, shared),
        "uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, score double, rare array<struct<word binary, k long>>, deep array<struct<gram long, k long>>",
    ), "ctw-scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.k")
    known = counts.where(F.col("n") < model["frequent"])
    words = (
        rare.join(known, "word", "left")
        .select("uid", "k", F.coalesce("n", F.lit(0)).alias("n"))
        .groupBy("uid")
        .agg(F.sum(F.col("k") * (F.log10(F.col("n") + 1) - math.log10(tokens + distinct + 1))).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"), F.lit(0.0).alias("rare_score"))
    )
    deep = scored.select("uid", F.explode("deep").alias("r")).select("uid", "r.gram", "r.k").join(values, "gram")
    grams_of = deep.groupBy("uid").agg(F.lit(0.0).alias("rare_base"), F.lit(0).cast("long").alias("rare_known"), F.sum(F.col("k") * F.col("value")).alias("rare_score"))
    sums = words.unionByName(grams_of).groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("rare_base", "rare_known", "rare_score")])
    scored = scored.drop("rare", "deep")
    return scored.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        F.when(F.col("n_bytes") > 0, -(F.col("score") + F.coalesce("rare_score", F.lit(0.0))) * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
