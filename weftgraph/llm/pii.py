"""Personal data and what gives it away, in DataFrame functions alone.

Base spans are e-mail, IP, card and phone numbers.  Each is an entity to protect, by value
and by coarser names.  Terms (runs of letters and digits) near an entity are counted with
it over the whole corpus: with N documents, n_t holding term t, n_e holding entity e and
n_te holding both, t discloses e to the degree PMI = log2(n_te * N / (n_t * n_e)), and
P(e | t) is n_te / n_t.  Terms at or above the thresholds join the spans wherever they
stand.  Sanitising puts a base span's kind in its place and removes such terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

NEAR = 120  # code points on either side of an entity that count as near it
MIN_DOCS, MIN_SHARE, MIN_BITS, MIN_TERM = 3, 0.8, 6.0, 4
KINDS = ("email", "ip", "card", "phone", "term")
SPAN = "struct<s:int,o:int,e:int,v:string>"
BLOCK = 1024  # code points; see blocks()
BESIDE = 80  # spans on either side that are held against a term; see contexts()
FAR = (1 << 31) - 1

#: The matches of the base patterns, found in linear time: no match starts inside a run
#: that an earlier start would have taken, and quantifiers that nothing follows are
#: possessive.  The card pattern takes runs of 12 digits at least, as shorter ones fail.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"


def empty() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def scan(a: Column, join) -> Column:
    """Running totals of an array under an associative function, in log2(n) passes: an
    array that grows by one element a step would be copied as often as it has elements."""
    steps = F.when(F.size(a) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    far = lambda acc, i, k: F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, a, lambda acc, k: F.transform(acc, lambda x, i: F.when(far(acc, i, k).isNotNull(), join(far(acc, i, k), x)).otherwise(x)))


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points; stretch() and its callers reach into a long
    text by these, as counting code points from its start would take as long as it is."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def stretch(parts: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text given by its blocks."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    within = F.substring(block(i), start - i * BLOCK + 1, end - start)
    across = F.concat(F.substring(block(i), start - i * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), end - j * BLOCK))
    return F.when(i == j, within).otherwise(across)


def spans(text: Column, pattern: str, order: int) -> Column:
    """All matches of a pattern as structs (s, o, e, v): code points, kind, text.  The
    stretches between the matches give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("e"), F.length(m).alias("n"), m.alias("v")))
    total = scan(pairs, lambda a, x: F.struct((a["e"] + x["e"]).alias("e"), x["n"].alias("n"), x["v"].alias("v")))
    return F.when(F.size(found) > 0, F.transform(total, lambda x: F.struct((x["e"] - x["n"]).alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), x["v"].alias("v")))).otherwise(empty())


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    r = F.reverse(d)
    def value(i):
        x = F.substr(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str):
    if kind == "ip":
        return lambda x: F.forall(F.split(x["v"], r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return lambda x: F.length(digits(x["v"])).between(12, 19) & F.when(F.length(digits(x["v"])) <= 19, luhn(digits(x["v"]))).otherwise(False)
    if kind == "phone":
        return lambda x: F.length(digits(x["v"])).between(9, 15)
    return lambda x: F.lit(True)


def base_spans(text: Column) -> Column:
    """The valid base spans of a text, by start and kind."""
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.contains(text, F.lit("+"))}
    parts = [F.when(hint[k], F.filter(spans(text, p, o), valid(k))).otherwise(empty()) for o, (k, p) in enumerate(PATTERNS.items())]
    return F.sort_array(F.concat(*parts))


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and k, which tells rows apart: rows of one k and doc_id
    have one text and so the same spans."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t")).withColumn("k", F.xxhash64("doc_id", "t"))


def entities(b: Column) -> Column:
    """A base span's names, from its own value to its kind: what is too rare to be judged
    by value is judged by e-mail name or host, network, issuer, and kind."""
    value = F.when(b["o"] == 0, F.lower(b["v"])).otherwise(digits(b["v"]))
    name = F.when(b["o"] == 0, F.concat(F.lit("name:"), F.lower(F.substring_index(b["v"], "@", 1))))
    wider = F.when(b["o"] == 0, F.concat(F.lit("host:"), F.lower(F.substring_index(b["v"], "@", -1)))).when(b["o"] == 1, F.concat(F.lit("net:"), F.regexp_extract(b["v"], r"^(.*)\.", 1))).when(b["o"] == 2, F.concat(F.lit("issuer:"), F.substring(digits(b["v"]), 1, 6)))
    return F.transform(F.array_compact(F.array(value, name, wider, F.lit("kind"))), lambda x: F.concat(b["o"], F.lit(":"), x))


def terms(t: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.split(F.lower(t), r"[^\p{L}\p{N}]+"))


def contexts(found: DataFrame) -> DataFrame:
    """Distinct (entity, term) for each term near a base span and in none of the BESIDE spans
    on either side of that one (more do not fit in its surroundings)."""
    n = F.col("n")

    def one(b, i):
        l0, r1 = F.greatest(b["s"] - NEAR, F.lit(0)), F.least(b["e"] + NEAR, n)
        beside = F.filter(F.slice("base", F.greatest(i - BESIDE, F.lit(0)) + 1, F.lit(2 * BESIDE + 1)), lambda x: (x["s"] < r1) & (x["e"] > l0))
        return F.struct(entities(b).alias("entities"), beside.alias("beside"), l0.alias("l0"), stretch(F.col("parts"), l0, b["s"]).alias("left"), b["e"].alias("r0"), stretch(F.col("parts"), b["e"], r1).alias("right"), n.alias("n"))

    near = found.select("base", blocks(F.col("t")).alias("parts"), F.length("t").alias("n")).select(F.explode(F.transform("base", one)).alias("c")).select("c.*")
    # a word that the edge of the stretch cuts is not whole, unless the text ends there
    left = F.filter(spans(F.col("left"), TERM, 4), lambda x: (x["s"] > 0) | (F.col("l0") == 0))
    right = F.filter(spans(F.col("right"), TERM, 4), lambda x: (x["e"] < NEAR) | (F.col("r0") + x["e"] >= F.col("n")))
    free = lambda s, e: ~F.exists("beside", lambda b: (s < b["e"]) & (e > b["s"]))
    good = lambda a, by: F.transform(F.filter(a, lambda x: (F.length(x["v"]) >= MIN_TERM) & x["v"].rlike(r"\p{L}") & free(x["s"] + by, x["e"] + by)), lambda x: F.lower(x["v"]))
    near = near.select("entities", F.explode(F.array_distinct(F.concat(good(left, F.col("l0")), good(right, F.col("r0"))))).alias("term"))
    return near.select(F.explode("entities").alias("entity"), "term").distinct()


def revealing(docs: DataFrame) -> DataFrame:
    """(entity, term) of the terms that disclose an entity; every row counts as a document."""
    found = rows(docs)
    based = cut(found.withColumn("base", base_spans(F.col("t"))).where(F.size("base") > 0), "pii-entities")
    held = based.select("t", F.explode(F.array_distinct(F.flatten(F.transform("base", entities)))).alias("entity"))
    holding = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = held.select("entity", F.explode(terms(F.col("t"))).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= MIN_DOCS)
    everywhere = found.select(F.explode(terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    share = F.col("n_te") / F.col("n_t")
    likely = pairs.join(contexts(based), ["entity", "term"]).join(everywhere, "term").where(share >= MIN_SHARE)
    bits = F.log2(share * found.count() / F.col("n_e"))
    return cut(likely.join(holding, "entity").where(bits >= MIN_BITS).select("entity", "term"), "pii-reveal")


def disclosing(docs: DataFrame) -> DataFrame:
    """(k, doc_id, names): the disclosing terms in each row that has any, of whichever
    document; frequent terms meet in a join that may be split."""
    reveal = revealing(docs).select("term").distinct()
    each = rows(docs).select("k", "doc_id", F.explode(terms(F.col("t"))).alias("term"))
    return each.join(reveal, "term").groupBy("k", "doc_id").agg(F.collect_set("term").alias("names"))


def places(text: Column, names: Column, base: Column) -> Column:
    """Spans of the terms in `names`, wherever they stand outside base spans."""
    terms = F.filter(F.transform(spans(text, TERM, 4), lambda x: x.withField("v", F.lower(x["v"]))), lambda x: F.array_contains(names, x["v"]))
    # sorted among the base spans, a term overlaps one if the furthest end before it lies
    # beyond its start or the next base span starts before its end
    both = F.array_sort(F.concat(base, terms))
    reach = scan(F.transform(both, lambda x: F.when(x["o"] < 4, x["e"]).otherwise(0)), F.greatest)
    ahead = F.reverse(scan(F.reverse(F.transform(both, lambda x: F.when(x["o"] < 4, x["s"]).otherwise(FAR))), F.least))
    free = F.transform(both, lambda x, i: F.when((x["o"] == 4) & (F.get(reach, i) <= x["s"]) & (F.get(ahead, i) >= x["e"]), x))
    return F.when(F.size(terms) > 0, F.array_compact(free)).otherwise(empty())


def joined(x: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["o"] + 1)
    return F.concat(kind, F.lit(":"), x["s"], F.lit(":"), x["e"])


def with_terms(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """found (with k, doc_id, base) and the terms of each row, an empty array for most."""
    names = disclosing(docs).withColumnRenamed("doc_id", "_doc").withColumnRenamed("k", "_k")
    full = found.join(names, (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return full.withColumn("terms", F.when(F.col("names").isNotNull(), places(F.col(text), F.col("names"), F.col("base"))).otherwise(empty())).drop("_k", "_doc", "names")


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text is empty and has no spans.  Rows that repeat have the same spans each, and
    each counts as a document.  An empty table gives no rows.
    """
    base = rows(docs).withColumn("base", base_spans(F.col("t")))
    count = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return with_terms(base, docs, "t").select(
        "doc_id", *[count(o).alias(f"n_{k}") for o, k in enumerate(PATTERNS)],
        F.sha2(F.concat_ws(",", F.transform("base", joined)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.sort_array(F.concat("base", "terms")), joined)).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind, as in [EMAIL], and disclosing terms by
    [TERM]; all columns and all rows are kept, n_chars follows the text if it is there.

    Base spans of two kinds that overlap become one stretch, named by the earlier.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])  # no name in it clashes
    marked = docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    marked = marked.withColumn("k", F.xxhash64("doc_id", "_t")).withColumn("base", base_spans(F.col("_t")))
    full = with_terms(marked, docs, "_t").withColumn("_all", F.sort_array(F.concat("base", "terms")))
    tag = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["o"] + 1)), F.lit("]"))
    # a span that starts before the furthest end so far belongs to the stretch of an earlier
    reach = scan(F.transform("_all", lambda x: x["e"]), F.greatest)
    full = full.withColumn("_parts", F.when(F.size("_all") > 0, blocks(F.col("_t")))).withColumn("_reach", reach)
    heads = F.array_compact(F.transform("_all", lambda x, i: F.when((i == 0) | (x["s"] >= F.get("_reach", i - 1)), F.struct(x["s"].alias("s"), F.when(i > 0, F.get("_reach", i - 1)).otherwise(0).alias("at"), x["o"].alias("o")))))
    clean = F.concat(
        F.array_join(F.transform(heads, lambda x: F.concat(stretch(F.col("_parts"), x["at"], x["s"]), tag(x))), ""),
        stretch(F.col("_parts"), F.element_at("_reach", -1), F.length("_t")),
    )
    new = {"text": F.when(F.size("_all") > 0, clean).otherwise(F.col("row.text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("_all") > 0, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))
    return full.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
