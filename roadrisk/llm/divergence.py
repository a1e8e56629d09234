"""Divergence of the sources of a language from each other and from the language.

Terms are counted per (language, source) inside tasks, and the counts summed by a shuffle on (language, term). The divergences are
computed in a cube: the groups of a language are dealt to blocks, its terms to blocks as well, and a cell owns (group block, group
block, term block). The rows of a group block and term block are its slice; it is copied to each cell of that group block. A cell
compares its groups in pairs, in both directions, over its own terms, and the partial sums are added along the term axis.

A term that neither group of a pair has adds the same amount for each term, so cells compare the terms of their slices only and
measure them against that amount; the cells of the first term block add it once for all terms. Terms are thus never dealt to groups
that do not have them.

Everything is whole numbers: a share of probability is 1 + floor(SCALE * (count + 1) / (N + V)) with N occurrences and V kept terms,
a divergence floor((p - q) * (p - q) / q).

A cell holds at most about 2 * GROUPS x TERMS numbers. A hot source or term is split over the term blocks, since rows reach the
cells as counts.

Defined cases: null texts, languages and sources are empty; each row is a document, repeated ones too; a group without terms and a
language without kept terms take part with value 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.llm.shared import text_blocks, with_small_batches, written

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3  # of a kept term
TOP_TERMS = 200
GROUPS = 64  # of a group block, about
TERMS = 2048  # of a term block, about
HELD_TERMS = 500_000  # counters of a task before they are sent on
HELD_DOCUMENTS = 1 << 22  # documents in the counters, at most
DOCUMENT = 1 << 40  # one document in a counter; occurrences stay below it

LETTER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTER_BYTES).split() if text else []


# --- counts ----------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows (lang, source, term, n, docs)."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences, and documents above DOCUMENT
    size = seen = 0

    def rows():
        for (lang, source), counts in held.items():
            packed = np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(counts), pa.string()),
                    pa.array([source] * len(counts), pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(packed % DOCUMENT, pa.int64()),
                    pa.array(packed // DOCUMENT, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch, texts in text_blocks(batches):
        langs, sources = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
        for lang, source, text in zip(langs, sources, texts, strict=True):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            for word, n in Counter(terms_of(text)).items():
                counts[word] = counts.get(word, 0) + n + DOCUMENT
            size, seen = size + len(counts) - before, seen + 1
            if size > HELD_TERMS or seen >= HELD_DOCUMENTS:
                yield from rows()
                held.clear()
                size = seen = 0
    yield from rows()


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n) of the kept terms, with all_n, the occurrences in the language, and first, whether the row
    is the first one of its term. One shuffle, of the counts of tasks."""
    parts = with_small_batches(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    sums = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = Window.partitionBy("lang", "term")
    sums = sums.select(
        "lang", "source", "term", "n", F.sum("docs").over(per_term).alias("docs"), F.sum("n").over(per_term).alias("all_n"),
        (F.row_number().over(per_term.orderBy("source")) == 1).alias("first"),
    )
    return written(sums.filter(F.col("docs") >= least).drop("docs"))


def share(count: Column, occurrences: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (occurrences + terms)), exact beyond 64 bits."""
    whole = F.lit(SCALE).cast("decimal(18,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", whole, (occurrences + terms).cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- the cube --------------------------------------------------------------------------------------


def _partial(groups: list[str], others: list[str], p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray, terms: int | None) -> Iterator[tuple]:
    """(group, other, sum) over the columns of ``p`` and ``q``, as a difference to what absent terms would add; ``terms``: all
    terms of the language, for which the absent ones' amount is added, or None."""
    for k, name in enumerate(groups):
        away = p0[k] - q0
        absent = away * away // q0
        away = p[k] - q
        sums = (away * away // q - absent[:, None]).sum(axis=1)
        if terms is not None:
            sums += absent * terms
        for other, value in zip(others, sums.tolist(), strict=True):
            if other != name:
                yield name, other, value


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences between the groups of two blocks over one block of terms."""
    lang, i, j, t = (table.column(c)[0].as_py() for c in ("lang", "i", "j", "t"))
    block, p, total = (table.column(c).to_numpy() for c in ("block", "p", "terms"))
    named, words = (pa.concat_arrays(table.column(c).chunks).dictionary_encode() for c in ("source", "term"))
    source = named.indices.to_numpy()
    is_term = words.is_valid().to_numpy(zero_copy_only=False)
    term = words.indices.fill_null(0).to_numpy()
    names, place = named.dictionary.to_pylist(), np.zeros(len(named.dictionary), np.int64)
    groups, absent, shares = {}, {}, {}
    for own in {i, j}:
        rows = np.flatnonzero(~is_term & (block == own))
        groups[own], absent[own] = [names[k] for k in source[rows]], p[rows]
        place[source[rows]] = np.arange(len(rows))
        shares[own] = np.repeat(absent[own][:, None], len(words.dictionary), axis=1)
        rows = np.flatnonzero(is_term & (block == own))
        shares[own][place[source[rows]], term[rows]] = p[rows]
    found: list[tuple] = []
    for a, b in {(i, j), (j, i)}:
        found += _partial(groups[a], groups[b], shares[a], shares[b], absent[a], absent[b], int(total[0]) if t == 0 else None)
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    return pa.table({
        "lang": pa.array([lang] * len(found), pa.string()),
        "source": pa.array(columns[0], pa.string()),
        "item": pa.array(columns[1], pa.string()),
        "value": pa.array(columns[2], pa.int64()),
    })


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, groups_each: int = GROUPS, terms_each: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other one of its language (``pair``), and
    the ``top`` terms by which it exceeds its language (``term``)."""
    docs = documents(docs)
    kept = kept_counts(docs, least)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("v"))
    groups = docs.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count("*").alias("members"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"])
    group_blocks = F.ceil(F.col("members") / groups_each).cast("int")
    groups = written(
        groups.select(
            "lang", "source", "v", "lang_n", "group_n", group_blocks.alias("group_blocks"), F.greatest(F.ceil(F.col("v") / terms_each), F.lit(1)).cast("int").alias("term_blocks"),
            F.pmod(F.xxhash64("lang", "source"), group_blocks).cast("int").alias("block"),
        )
    )
    none = F.lit(None).cast("string")
    first = F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v"))).otherwise(1)
    rows = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("group_n"), F.col("v"))
    slices = rows.select(
        "lang", "source", "term", p.alias("p"), "block", "group_blocks", "v", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("t")
    ).unionByName(
        groups.select("lang", "source", none.alias("term"), first.alias("p"), "block", "group_blocks", "v", F.explode(F.expr("sequence(0, term_blocks - 1)")).alias("t"))
    )
    cells = slices.withColumn("other", F.explode(F.expr("sequence(0, group_blocks - 1)"))).select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "block", "source", "term", "p", F.col("v").alias("terms")
    )
    partial = cells.groupBy("lang", "i", "j", "t").applyInArrow(_cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    q = share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    terms = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", F.row_number().over(by_value).alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns).filter(F.col("rank") <= top))
