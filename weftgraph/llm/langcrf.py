"""Language identification by a linear-chain conditional random field over words.

The chain's states are the languages that the training rows name.  A word's features
are the byte n-grams of its marked form (those that hold a mark are its affixes), the
word itself, and the lexicons it belongs to; their weights and the transitions between
languages are learned by maximum likelihood.  Chains of one language and chains spliced
from several teach the transitions of code-switched text.  Forward-backward gives every
word its posterior; a text's language has the largest mean posterior over its words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, fold, ship, text_bytes, trimmed

SAMPLE = 120  # training documents for each language, those of the smallest hash
SAMPLE_BYTES = 2 << 20  # of their text, for each language
MAX_LANGUAGES = 1000
MIN_SCORE = 0.5  # least mean posterior with which keep_identified() keeps a text
LEXICON = 500  # words of each language's lexicon
HASH_BITS = 17
GRAMS = (1, 2, 3, 4)
EPOCHS, RATE, DECAY = 4, 0.25, 1e-6
KEEP = 200_000
CHUNK = 512 << 10  # small, as what a chunk takes is some 100 times its bytes
CELLS = 100_000  # words, padding included, of the chains that are run together
LEARN = 4096  # words whose features are made together
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_process: dict = {}


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one after the other, and where each word's begin."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    sizes = np.array([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    ends = np.cumsum(sizes)
    left = ends[owner] - np.arange(len(buf))  # bytes of the word from here on
    parts, owners = [], []
    code = np.zeros(len(buf), np.uint64)
    for n in GRAMS:
        shifted = np.zeros(len(buf), np.uint64)
        shifted[: len(buf) - n + 1] = buf[n - 1 :]
        code = (code << np.uint64(8)) | shifted
        at = np.flatnonzero(left >= n)
        parts.append((code[at] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS))
        owners.append(owner[at])
    parts.append(np.array([zlib.crc32(r) & ((1 << HASH_BITS) - 1) for r in raw], np.uint64))
    owners.append(np.arange(len(raw)))
    own, feats = np.concatenate(owners), np.concatenate(parts).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return feats[order], np.searchsorted(own[order], np.arange(len(raw)))


def split_words(text: str) -> tuple[list[str], list[int]]:
    """Lower-cased words, and the number of words up to the end of each line."""
    out: list[str] = []
    stops = []
    for line in text.lower().split("\n"):
        out.extend(line.split())
        stops.append(len(out))
    return out, stops


def forward_backward(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of all words (and expected transitions) of chains in log space.

    emit: scores of all words, chain by chain.  Chains are padded to the longest of their
    group; groups gather chains of like length.
    """
    post = np.empty_like(emit)
    move = np.exp(trans)
    expected = np.zeros_like(trans)
    order = np.argsort(-sizes, kind="stable")
    a = 0
    while a < len(order):
        longest = sizes[order[a]]
        b = a + int(np.searchsorted(-sizes[order[a:]], -max(1, longest * 3 // 4), side="right"))
        b = min(b, a + max(1, CELLS // max(1, longest)))
        group = order[a:b]
        a = b
        length = sizes[group]
        at = starts[group][:, None] + np.minimum(np.arange(longest), length[:, None] - 1)
        e = emit[at]
        e = np.exp(e - e.max(2, keepdims=True))
        live = np.arange(longest) < length[:, None]
        fwd = np.empty_like(e)
        now = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        fwd[:, 0] = now
        for t in range(1, longest):
            n = int(np.searchsorted(-length, -t, side="left"))  # chains longer than t
            now = (now[:n] @ move) * e[:n, t]
            now /= now.sum(1, keepdims=True)
            fwd[:n, t] = now
        back = np.ones((len(group), e.shape[2]))
        p = np.empty_like(e)
        for t in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-length, -t, side="left"))
            g = fwd[:n, t] * back[:n]
            p[:n, t] = g / g.sum(1, keepdims=True)
            if t:
                nxt = e[:n, t] * back[:n]
                if pairs:
                    joint = fwd[:n, t - 1][:, :, None] * move[None] * nxt[:, None, :]
                    expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                new = nxt @ move.T
                back[:n] = new / new.sum(1, keepdims=True)
        post[at[live]] = p[live]
    return post, expected


def train(rows: list[tuple[str, str]], seed: int = 1) -> dict | None:
    """A model from (language, text) rows; None if no row has a word."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    chains: list[tuple[np.ndarray, np.ndarray]] = []
    for lang, text in rows:
        w, stops = split_words(text)
        ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64)
        cuts = sorted({0, *stops, *(i + 1 for i, x in enumerate(w) if x[-1] in ".!?")})
        chains += [(ids[a:b], np.full(b - a, number[lang])) for a, b in zip(cuts, cuts[1:])]
    if not chains:
        return None
    mixed = []
    order = rng.permutation(len(chains))
    for a, b in zip(order[::2], order[1::2]):  # code-switched: one chain set into another
        (xa, ya), (xb, yb) = chains[a], chains[b]
        at, n = rng.integers(0, len(xa) + 1), rng.integers(1, len(xb) + 1)
        mixed.append((np.r_[xa[:at], xb[:n], xa[at:]], np.r_[ya[:at], yb[:n], ya[at:]]))
    chains += mixed
    counts = np.zeros((len(vocabulary), len(languages)))
    for x, y in chains:
        np.add.at(counts, (x, y), 1)
    share = (counts + 0.1) / (counts + 0.1).sum(0)
    lexicon: dict[str, int] = {}
    words = list(vocabulary)
    for k in range(len(languages)):
        for i in np.argsort(-counts[:, k] * np.log(share[:, k] / np.delete(share, k, 1).max(1) if len(languages) > 1 else np.e), kind="stable")[:LEXICON].tolist():
            if counts[i, k]:
                lexicon[words[i]] = lexicon.get(words[i], 0) | 1 << k
    feats, begin = features(words)
    end = np.r_[begin[1:], len(feats)]
    member = np.array([[(lexicon.get(w, 0) >> k) & 1 for k in range(len(languages))] for w in words], float)
    n_states = len(languages)
    weight, lex, trans = np.zeros((1 << HASH_BITS, n_states)), np.zeros((n_states, n_states)), np.zeros((n_states, n_states))
    squares = [np.full(x.shape, 1e-6) for x in (weight, lex, trans)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), 1500):
            some = [chains[i] for i in order[a : a + 1500]]
            x, y = np.concatenate([c[0] for c in some]), np.concatenate([c[1] for c in some])
            sizes = np.array([len(c[0]) for c in some])
            starts = np.cumsum(sizes) - sizes
            met, back = np.unique(x, return_inverse=True)
            span = end[met] - begin[met]
            index = np.repeat(begin[met] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            f = feats[index]
            emission = np.add.reduceat(weight[f], np.cumsum(span) - span) + member[met] @ lex
            post, expected = forward_backward(emission[back], starts, sizes, trans, True)
            diff = -post
            diff[np.arange(len(y)), y] += 1
            per_word = np.stack([np.bincount(back, diff[:, k], len(met)) for k in range(n_states)], 1)
            rows_of = np.repeat(np.arange(len(met)), span)
            grad = np.stack([np.bincount(f, per_word[rows_of, k], 1 << HASH_BITS) for k in range(n_states)], 1) / len(some)
            inner = np.ones(len(y), bool)
            inner[starts] = False
            seen = np.zeros_like(trans)
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            for param, square, g in ((weight, squares[0], grad - DECAY * weight), (lex, squares[1], member[met].T @ per_word / len(some)), (trans, squares[2], (seen - expected) / len(some))):
                square += g * g
                param += RATE * g / np.sqrt(square)
    return {"languages": languages, "weight": weight.astype(np.float32), "lex": lex, "trans": trans, "lexicon": lexicon}


class Tagger:
    """Scores of the words met so far, in a table of bounded size."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self):
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model["languages"])))
        self.letter, self.stop = np.zeros(0, bool), np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        m = self.model
        held = [self.emit]
        for part in (new[a : a + LEARN] for a in range(0, len(new), LEARN)):
            feats, begin = features(part)
            member = np.array([[(m["lexicon"].get(w, 0) >> k) & 1 for k in range(len(m["languages"]))] for w in part], float)
            held.append(np.add.reduceat(m["weight"][feats], begin).astype(float) + member @ m["lex"])
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.emit = np.concatenate(held)
        self.letter = np.r_[self.letter, [bool(_LETTER.search(w)) for w in new]]
        self.stop = np.r_[self.stop, [w[-1] in ".!?" for w in new]]

    def posteriors(self, texts: list[str]):
        """Word ids, posteriors, and words of each text."""
        split = [split_words(t) for t in texts]
        met = set().union(*(w for w, _ in split)) if split else set()
        if len(self.ids) + len(met) > KEEP:
            self.reset()
        if new := sorted(met.difference(self.ids)):
            self.learn(new)
        sizes = np.array([len(w) for w, _ in split])
        x = np.fromiter((i for w, _ in split for i in map(self.ids.__getitem__, w)), np.int64, sizes.sum())
        breaks = self.stop[x] if len(x) else np.zeros(0, bool)
        before = np.cumsum(sizes) - sizes
        stops = [b + s - 1 for b, (_, line) in zip(before.tolist(), split) for s in line if s]
        breaks[stops] = True
        ends = np.flatnonzero(breaks) + 1
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        post = forward_backward(self.emit[x], starts, ends - starts, self.model["trans"])[0] if len(x) else np.zeros((0, len(self.model["languages"])))
        return x, post, sizes


def label_words(model: dict, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of a text."""
    tagger = Tagger(model)
    _, post, _ = tagger.posteriors([text])
    w = split_words(text)[0]
    return [(a, model["languages"][k], float(p[k])) for a, p, k in zip(w, post, post.argmax(1))]


def _predict(batches, shared, mod: int, rest: int):
    model = shared.value
    if model is not None and _process.get("of") is not model:
        _process.update(of=model, tagger=Tagger(model))
    for ids, raw in chunks(batches, CHUNK):
        texts = [t.decode("utf-8", "replace") for t in raw]
        langs, scores, switches = [UNKNOWN] * len(ids), [0.0] * len(ids), [0] * len(ids)
        if model is not None:
            tagger = _process["tagger"]
            x, post, sizes = tagger.posteriors(texts)
            letters = tagger.letter[x]
            best = post.argmax(1) if len(post) else np.zeros(0, int)
            at = 0
            for k, n in enumerate(sizes.tolist()):
                use = letters[at : at + n]
                if use.any():
                    mean = post[at : at + n][use].mean(0)
                    top = int(mean.argmax())
                    path = best[at : at + n][use]
                    langs[k], scores[k], switches[k] = model["languages"][top], float(min(1.0, mean[top])), int((path[1:] != path[:-1]).sum())
                at += n
        out = [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids]
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out), "lang_pred": pa.array(langs), "score": pa.array(scores, pa.float64()), "n_switches": pa.array(switches, pa.int64())})


def fit(docs: DataFrame, mod: int = 4, rest: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """Train on at most `sample` documents for each language, those of the training fold
    with the smallest hashes of their ids and texts, and of these on as many as `sample_bytes`
    of text hold in that order.  That and the number of languages, which may not exceed
    MAX_LANGUAGES, bound what the driver holds.  Rows without a doc_id are training data;
    of rows that repeat one is taken."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(fold(F.col("doc_id"), mod) == rest, F.lit(False)))
    marked = labelled.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("size", F.octet_length("text").cast("long"))
    fits = marked.where(F.col("size") <= sample_bytes).select("lang", "h", "size")
    # hashes that can be among the smallest, by the language's number of rows; no language's
    # rows meet in one task
    rows = F.broadcast(fits.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1))
    small = F.shiftrightunsigned("h", 11) / float(1 << 53) < F.lit(16.0 * sample) / F.col("rows")
    order = Window.partitionBy("lang").orderBy("place")
    pick = fits.join(rows, "lang").where(small).select("lang", "h", "size", F.shiftrightunsigned("h", 1).alias("place")).distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample)
    pick = pick.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= sample_bytes).select("lang", "h")
    pick = cut(pick, "crf-sample")
    languages = pick.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if not languages:
        return None
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = marked.select("lang", "h", "doc_id", "text").join(F.broadcast(pick), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()
    rows = sorted((r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in rows)
    return train([(lang, text) for lang, _, _, text in rows])


def identify(docs: DataFrame, mod: int = 4, rest: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (mean posterior of that
    language), n_switches (changes of language between words).

    Learns from training rows' text and lang alone.  `und` with score 0 if a text is null
    or has no letter, or if there is nothing to learn from.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, mod, rest, sample))
    return text_bytes(docs).mapInArrow(lambda it: _predict(it, shared, mod, rest), "doc_id long, held_out boolean, lang_pred string, score double, n_switches long")


def _keep(batches, shared, languages, min_score: float):
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
        known = [
            lang != UNKNOWN and score >= min_score and (languages is None or lang in languages)
            for out in _predict([rows], shared, 1, 1) for lang, score in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())
        ]
        yield batch.filter(pa.array(known, pa.bool_()))


def keep_identified(docs: DataFrame, mod: int = 4, rest: int = 2, sample: int = SAMPLE, languages: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted language is one of
    `languages` (None: any that was learned) with a score of `min_score` or more, in one
    pass.  Null texts and texts without a letter go; an empty table stays empty."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, mod, rest, sample))
    return docs.mapInArrow(lambda it: trimmed(_keep(it, shared, languages, min_score)), docs.schema)
