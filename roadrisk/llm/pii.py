"""Personal data: patterns, and words of the document that disclose a value by information content.

Base spans (email, ip, card, phone) come from patterns. Every distinct value found is a protected entity. All words of a
document that holds a value are terms that may reveal it: with document frequencies over the whole corpus, a term t
discloses an entity e as far as PMI(t, e) reaches the information content of e, PMI / IC = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)).
Pairs seen in fewer than ``SUPPORT`` documents have a smoothed estimate: one more document with t, which holds e as often as
any does, (n(t,e) + n(e) / N) / (n(t) + 1) in place of n(t,e) / n(t). From ``THRESHOLD`` on (1: the term occurs nowhere else) each
occurrence of the term in the documents that hold the value and the term is a span: removed when the term is certain to reveal
the value, generalised otherwise. A smoothed estimate is never certain.

DataFrame functions only. A term in too many documents to reach the threshold for any value of a document is left out
before pairs are made, which loses none: n(t,e) is at most n(e), so n(t) is at most n(e)^0.8 N^0.2. Word counts are combined
before they are shuffled.

Defined cases: a null text is an empty one; a value found several times in a document counts once; overlapping spans of
different kinds are all reported and masked as one; repeated rows (same id and text) each get the same spans; null
ids are kept; documents without a value keep all their words; other columns ride along in ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadrisk.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns. Starts inside a run that has already failed are skipped, and repeats do not go back,
# neither of which changes what is found.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # without it a text has no match
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"  # letters and characters beyond ASCII
SUPPORT = 3
THRESHOLD = 0.8
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Does the check digit fit?"""
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: _worth(digits, k)), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _worth(digits: Column, k: Column) -> Column:
    """What the k-th digit from the right adds."""
    digit = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
    return F.when(k % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """Valid matches of a kind with their code point positions: between matches stand the pieces of a split."""
    pattern, number = F.lit(PATTERNS[kind]), KINDS.index(kind)
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(seen, piece):
        begin = seen["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["value"])
        span = F.struct(F.lit(number).alias("kind"), begin.alias("start"), end.alias("end"), piece["value"].alias("value"))
        known = F.when(piece["value"].isNull(), seen["spans"]).otherwise(F.concat(seen["spans"], F.array(span)))
        return F.struct(F.coalesce(end, begin).alias("at"), known.alias("spans"))

    found = F.filter(F.aggregate(pieces, start, step)["spans"], lambda s: _valid(kind, s["value"]))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    likely = F.contains(text, F.lit(HINTS[kind])) & F.rlike(text, F.lit("[0-9]" if kind != "email" else "@[A-Za-z0-9-]"))
    return F.when(likely, found).otherwise(empty)


def _key(text: Column) -> Column:
    """A document: its id and text."""
    return F.xxhash64(F.col("doc_id"), text)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def base_spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, base (array of spans), and the text where it has any."""
    rows = docs.select("doc_id", _key(_text()).alias("key"), _text().alias("text"))
    rows = rows.withColumns({f"{kind}_": spans_of(kind, F.col("text")) for kind in PATTERNS})
    rows = rows.withColumn("base", F.concat(*[F.col(f"{kind}_") for kind in PATTERNS]))
    return rows.select("key", "doc_id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _occurrences(text: Column, terms: Column) -> Column:
    """Spans of all words of a text that are among the terms."""
    pieces = F.arrays_zip(F.split(text, TERM, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("word"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(seen, piece):
        first = seen["at"] + F.length(piece["gap"])
        after = first + F.length(piece["word"])
        term = F.lower(piece["word"])
        span = F.struct(F.lit(KINDS.index("term")).alias("kind"), first.alias("start"), after.alias("end"), term.alias("value"))
        known = F.when(F.array_contains(terms, term), F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"])
        return F.struct(F.coalesce(after, first).alias("at"), known.alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def disclosing(docs: DataFrame, base: DataFrame, support: int, threshold: float) -> DataFrame:
    """key, words (the terms of that document that disclose one of its values), sure (those certain to)."""
    valued = base.filter(F.size("base") > 0).dropDuplicates(["key"])
    values = valued.select("key", F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("value"))
    entities = values.groupBy("value").agg(F.count("*").alias("n_e"))
    total, most = docs.count(), entities.agg(F.max("n_e")).first()[0] or 0
    vocabulary = docs.select(F.explode(_distinct_words(_text())).alias("term"))
    counts = vocabulary.groupBy("term").agg(F.count("*").alias("n_t"))
    counts = counts.filter(F.col("n_t") <= most**threshold * total ** (1 - threshold) * (1 + 1e-9))
    # letters stand in no values but emails
    outside = F.regexp_replace("text", PATTERNS["email"], " ")
    terms = valued.select("key", F.explode(_distinct_words(outside)).alias("term")).join(counts, "term")
    rate = F.col("n_e") / float(total)
    reachable = F.least("n_t", "n_e") / F.col("n_t") >= F.pow(rate, 1 - threshold) * (1 - 1e-9)
    near = written(terms.join(values.join(entities, "value"), "key").filter(reachable & (F.col("n_e") < total)))
    pairs = near.groupBy("value", "term", "n_e", "n_t").agg(F.count("*").alias("n_te"))
    seen = F.col("n_te") / F.greatest("n_t", "n_te")
    smoothed = (F.col("n_te") + rate) / (F.col("n_t") + 1)
    share = F.when(F.col("n_te") >= support, seen).otherwise(smoothed)
    strong = pairs.withColumn("strength", 1 - F.log(share) / F.log(rate)).filter(F.col("strength") >= threshold)
    sure = (F.col("n_te") >= support) & (F.col("strength") >= 1 - 1e-9)
    marked = near.select("key", "value", "term").join(strong.select("value", "term", sure.alias("sure")), ["value", "term"])
    return marked.groupBy("key").agg(F.collect_set("term").alias("words"), F.collect_set(F.when(F.col("sure"), F.col("term"))).alias("sure"))


def protected(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """key, doc_id, base, terms, certain (starts of terms to remove) of each document."""
    base = written(base_spans(docs))
    joined = base.join(disclosing(docs, base, support, threshold), "key", "left")
    found = F.filter(_occurrences(F.col("text"), F.col("words")), lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    joined = joined.withColumn("terms", F.when(F.col("words").isNotNull(), found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))
    certain = F.transform(F.filter("terms", lambda w: F.array_contains("sure", w["value"])), lambda w: w["start"])
    return joined.select("key", "doc_id", "base", "terms", F.coalesce(certain, F.expr("cast(array() as array<int>)")).alias("certain"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(rows: DataFrame) -> DataFrame:
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "terms")).alias("spans")
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns of a document) and its text with values masked, terms generalised or removed."""
    rows = docs.select(F.struct("*").alias("row"), _key(_text()).alias("key"), F.col("text").cast("string").alias("text"))
    found = protected(docs, support, threshold).filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["key"])
    rows = rows.join(found.select("key", "base", "terms", "certain"), "key", "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    mask = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    marks = F.transform(F.concat("base", "terms"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when((s["kind"] == 4) & F.array_contains("certain", s["start"]), "").otherwise(F.element_at(names, s["kind"] + 1)).alias("mask"),
    ))

    def step(seen, mark):
        gap = F.substring(F.col("text"), seen["at"] + 1, mark["start"] - seen["at"])
        fresh = F.struct(mark["end"].alias("at"), F.concat(seen["text"], gap, mark["mask"]).alias("text"))
        longer = F.struct(F.greatest(seen["at"], mark["end"]).alias("at"), seen["text"].alias("text"))
        return F.when(mark["start"] >= seen["at"], fresh).otherwise(longer)

    done = F.aggregate(F.array_sort(marks), mask, step)
    clean = F.concat(done["text"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return rows.select("row", F.when(F.col("base").isNull(), F.col("text")).otherwise(clean).alias("text"))
