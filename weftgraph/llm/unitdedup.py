"""Line and sentence deduplication over the whole corpus, with offsets kept.

Units are lines and, in lines of several sentences, the sentences, so that a passage that
was set into a longer line is caught too.  Units are normalised and hashed to 128 bits;
the digests are grouped globally and the occurrence of the smallest doc_id, at its first
offset, is kept.  The others are removed where they stand in a run of MIN_RUN words or
more: stock phrases that recur by chance stay, and short units between removed ones go
with them.  Spans are code points of the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, first_uid, ship, text_bytes

MIN_UNIT = 4  # words; shorter units are never hashed, they go with those around them
MIN_RUN = 20  # words of a run of repeated units
CHUNK = 2 << 20
_ENDS = re.compile(r"(?<=[.!?])[ \t]+")
LAST = (1 << 63) - 1
UNIT = "struct<hi:bigint,lo:bigint,s:bigint,e:bigint,w:int,own:boolean>"


def units(text: str):
    """(normalised unit, start, end, words) of each unit: lower case, white space collapsed."""
    at = 0
    for line in text.split("\n"):
        start = at
        for p in _ENDS.split(line):
            start = at + line.index(p, start - at)
            w = p.split()
            if w:
                yield " ".join(w).lower(), start, start + len(p), len(w)
            start += len(p)
        at += len(line) + 1


def runs(found, min_run: int = MIN_RUN, min_unit: int = MIN_UNIT):
    """(start, end, number of units) of the runs of at least min_run words, from
    (start, end, words, repeated) of a text's units in order.  Units of under min_unit words
    join the repeated units on both their sides."""
    start = end = None
    n = words = extra = extra_words = 0
    for s, e, w, repeated in [*found, (0, 0, min_unit, False)]:
        if w < min_unit:
            extra, extra_words = extra + 1, extra_words + w
        elif repeated:
            if start is None:
                start, n, words, extra, extra_words = s, 0, 0, 0, 0
            n, words, end, extra, extra_words = n + extra + 1, words + extra_words + w, e, 0, 0
        else:
            if start is not None and words >= min_run:
                yield start, end, n
            start = None


def _units(batches, min_unit: int):
    uid = first_uid()
    long = pa.int64()
    for ids, texts in chunks(batches, CHUNK):
        cols = [[] for _ in range(6)]
        offsets = [0]
        for t in texts:
            met = set()
            for u, s, e, w in units(t.decode("utf-8", "replace")):
                h = xxhash.xxh3_128_intdigest(u) if w >= min_unit else 0
                for col, x in zip(cols, ((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), s, e, w, w >= min_unit and h in met)):
                    col.append(x)
                met.add(h)
            offsets.append(len(cols[0]))
        kinds = (long, long, long, long, pa.int32(), pa.bool_())
        yield pa.record_batch({
            "uid": pa.array(range(uid, uid + len(ids)), long), "doc_id": pa.array(ids, long),
            "units": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["hi", "lo", "s", "e", "w", "own"])),
        })
        uid += len(ids)


def _spans(batches, min_run: int, min_unit: int):
    long = pa.int64()
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        n_units, removed, starts, ends, offsets = [], [], [], [], [0]
        for found, own, later in zip(batch.column("units").to_pylist(), batch.column("own").to_pylist(), batch.column("later").to_pylist()):
            gone = {*own, *(later or [])}
            n = 0
            for s, e, k in runs(((u["s"], u["e"], u["w"], i in gone) for i, u in enumerate(found)), min_run, min_unit):
                starts.append(s)
                ends.append(e)
                n += k
            n_units.append(len(found))
            removed.append(n)
            offsets.append(len(starts))
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, long), pa.array(ends, long)], ["s", "e"]))
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_units, long), pa.array(removed, long), spans], names=["doc_id", "n_units", "n_removed", "removed"])


def removed_spans(docs: DataFrame, min_run: int = MIN_RUN, min_unit: int = MIN_UNIT) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, removed (spans start, end by
    start, which neither overlap nor touch).

    Null texts have no units.  Rows that share a doc_id count as one document and keep
    their first occurrences each.  Rows without a doc_id rank last and as one document:
    they lose what rows with one hold, not what they share among themselves.  Within a
    text every later occurrence counts as repeated.  A digest that is very common is
    counted partly before the shuffle, and where it is joined back, the join may be split.
    """
    ship(docs.sparkSession)
    rows = cut(text_bytes(docs).mapInArrow(lambda it: _units(it, min_unit), f"uid long, doc_id long, units array<{UNIT}>"), "units")
    each = rows.select("uid", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.posexplode("units").alias("i", "u")).where((F.col("u.w") >= min_unit) & ~F.col("u.own")).select("uid", "rank", "i", "u.hi", "u.lo")
    firsts = each.groupBy("hi", "lo").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "first")
    later = each.join(firsts, ["hi", "lo"]).where("rank > first").groupBy("uid").agg(F.collect_list("i").alias("later"))
    own = F.expr("transform(filter(transform(units, (u, i) -> struct(u.own as own, i as i)), x -> x.own), x -> x.i)")
    slim = rows.select("uid", "doc_id", F.transform("units", lambda u: F.struct(u["s"].alias("s"), u["e"].alias("e"), u["w"].alias("w"))).alias("units"), own.alias("own"))
    return slim.join(later, "uid", "left").drop("uid").mapInArrow(lambda it: _spans(it, min_run, min_unit), "doc_id long, n_units long, n_removed long, removed array<struct<s long, e long>>")


def dedup(docs: DataFrame, min_run: int = MIN_RUN, min_unit: int = MIN_UNIT) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, removed_chars, and spans, the
    removed stretches as start:end (code points, end exclusive), comma-joined."""
    found = removed_spans(docs, min_run, min_unit)
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_units", "n_removed", chars.alias("removed_chars"), F.concat_ws(",", F.transform("removed", lambda x: F.concat(x["s"], F.lit(":"), x["e"]))).alias("spans"))


def cleaned(text: str, spans: str) -> str:
    """The text without the spans of dedup()."""
    at, out = 0, []
    for span in filter(None, spans.split(",")):
        s, e = map(int, span.split(":"))
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]])
