"""SimHash near-duplicates over deletion-variant signatures.

A 64-bit fingerprint is cut into 2 segments of 32 bits, fewer than the 3 that exact segments
would take for two differing bits: of fingerprints that differ in at most 2 (even 3)
bits, one segment differs in at most 1.  Each segment is indexed by its 32 variants with one bit deleted; equal
variants meet in an equality join and the whole fingerprints are verified there.
Fingerprints are made distinct first, so copies cost one row, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, discard, ship, text_bytes

SHINGLE, BITS = 3, 2
CHUNK = 4 << 20
SMALL = 64  # see links()
HOT, HOT_COPIES = 4096, 16  # see joined_copies()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if set in over half of the XXH64 hashes (seed 42) of the text's
    shingles of lower-cased words, repeats included; 0 for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(w[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, shingle: int):
    for ids, texts in chunks(batches, CHUNK):
        fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fp)})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, for every row; null texts have fp 0."""
    ship(docs.sparkSession)
    return text_bytes(docs).mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 one-wildcard keys for each fingerprint.  A key holds the other 31 bits
    of its segment, the wildcard's place and the segment's number."""
    place = F.explode(F.sequence(F.lit(0), F.lit(63)))
    seg = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, pmod(i, 32))")
    return fps.select("fp", place.alias("i")).select(F.shiftleft(seg.bitwiseAND(F.bitwise_not(bit)), 6).bitwiseOR(F.col("i").cast("long")).alias("key"), "fp")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most `bits` (3 at most) bits.

    Keys of one fingerprint alone go before the join.  Keys of over SMALL are refined: of
    two members of a bucket the other segment differs in at most `bits` bits, so of its
    bits + 1 pieces one is equal; members meet only under an equal piece.  That is exact
    too, and keeps large buckets from pairing whole.  A pair comes from one key and piece
    alone: the first segment that differs in one bit at most, the wildcard at that bit (the
    first, if none differs), the first equal piece.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments serve up to 3 differing bits")
    bounds = [32 * i // (bits + 1) for i in range(bits + 2)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    # small rows become 64 each, so they are dealt out widely, whatever was coalesced before
    keyed = variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    met = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    low, high = (lambda x: x.bitwiseAND(0xFFFFFFFF)), (lambda x: F.shiftrightunsigned(x, 32))
    first = F.col("key").bitwiseAND(63) < 32
    other = F.when(first, high(F.col("fp"))).otherwise(low(F.col("fp")))
    cutting = F.array(*[other.bitwiseAND(m).bitwiseOR(F.lit(k << 33)) for k, m in enumerate(masks)])
    both = met.select("key", "fp", F.explode(F.when(F.col("n") > SMALL, cutting).otherwise(F.array(F.lit(-1).cast("long")))).alias("piece"))
    a, b = both.select("key", "piece", F.col("fp").alias("a")), both.select("key", "piece", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    bit = lambda x: F.when(x == 0, 0).otherwise(F.bit_count(x - 1))  # noqa: E731 - of one bit at most
    place = F.when(F.bit_count(low(diff)) <= 1, bit(low(diff))).otherwise(bit(high(diff)) + 32)
    rest = F.when(first, high(diff)).otherwise(low(diff))
    equal = F.coalesce(*[F.when(rest.bitwiseAND(m) == 0, k) for k, m in enumerate(masks)])
    once = (F.col("key").bitwiseAND(63) == place) & ((F.col("piece") < 0) | (F.shiftright("piece", 33) == equal))
    return a.join(b, ["key", "piece"]).where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= bits) & once).select("a", "b")


def components(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node reachable, for every node of the pairs (a, b).  Pairs
    that are not settled within `rounds` are a ValueError.

    Alternates large-star and small-star rounds; each ends in a written table, so no
    lineage grows, nothing is collected, and a hub's links are aggregated partly first.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        older, edges = edges, cut(small.where("u <> v").distinct(), "edges")
        discard(older)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None and tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise ValueError(f"components not settled within {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id, n_links.

    component_id is the smallest doc_id reachable over links of at most `bits` differing
    bits, the own one included; n_links counts the other fingerprints linked to this one.
    Null and word-free texts have fingerprint 0 and are linked like any other.  Repeated
    rows and exact copies share a fingerprint and so a component.  Null doc_ids never
    name a component unless a component has no other.  An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, shingle), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    pairs = cut(links(reps.select("fp"), bits), "links")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    ids = roots.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(ids, "root").join(degree, "fp").select("fp", "component_id", "n_links")
    named = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = cut(named.join(reps.select("fp", "copies"), "fp"), "components")
    return joined_copies(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def joined_copies(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined to named (a row for each key, `copies` telling how many rows it has).  Keys
    of many copies are broadcast: as each has over 1 / HOT of all rows, they are HOT at
    most.  The others have few rows each and are shuffled."""
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > max(HOT_COPIES, total // HOT)
    often = F.broadcast(named.where(hot).drop("copies"))
    few = rows.join(F.broadcast(named.where(hot).select(key)), key, "left_anti").join(named.where(~hot).drop("copies"), key)
    return rows.join(often, key).unionByName(few)


def representatives(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, all columns kept.

    Of rows that repeat this doc_id one stays; rows without a doc_id can't be named by a
    component and stay all.
    """
    return named(docs, near_duplicates(docs, bits, shingle))


def named(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs that name a component in near (doc_id, component_id); see above."""
    keep = near.where("doc_id = component_id").select(F.col("doc_id").alias("k")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no name in it clashes
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    one = rows.where("k is not null").join(keep, "k", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("h"))).where("n = 1")
    return one.select("row").unionAll(rows.where("k is null").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
