"""Operators 11 to 13: comparisons with plain computations, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from roadrisk.llm import bpe, divergence, infill, queries
from tests.conftest import SMALL
from tests.llm.test_operators import DOCS, none, odd  # noqa: F401


def sha(value):
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


# --- 11 ---------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    """The audit of (lang, source, text) by definition."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(b, w) for a, b, w in docs if a == lang]
        kept = {t for t, n in Counter(t for _, w in own for t in set(w)).items() if n >= least}
        names = sorted({b for b, _ in own})
        counts = {b: Counter(t for s, w in own if s == b for t in w if t in kept) for b in names}
        whole = sum(counts.values(), Counter())

        def p(count, t):
            return 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept))

        for b in names:
            pairs = [(sum((p(counts[b], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in kept), o) for o in names if o != b]
            terms = [((p(counts[b], t) - p(whole, t)) ** 2 // p(whole, t), t) for t in kept if counts[b][t] and p(counts[b], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, b, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("groups", "terms", "held"), [(64, 2048, 300_000), (2, 3, 5)])
def test_audit_equals_definition_in_any_blocks(spark, monkeypatch, groups, terms, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rng = random.Random(3)
    words = ["Ash", "ash", "oak", "élan", "ЛЕС", "x1y", "yew", "fir", "elm", "box"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", "f", None]), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(150)]
    rows += [("fr", "lonely", "once"), ("fr", "other", None), ("en", "silent", "42 !"), *[("en", "hot", "oak ash oak")] * 60]
    docs = spark.createDataFrame([(k, t, a, b, "x") for k, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    got = divergence.audit(docs.repartition(3), top=4, groups_each=groups, terms_each=terms)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 4)


def test_audit_edge_cases(odd, none):  # noqa: F811
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, divergence.audit(odd).collect())) == plain_audit(rows, 3, 200)
    assert divergence.audit(none).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(10**12, 10**13, 7), (0, 3 * 10**9, 1), (9 * 10**12, 9 * 10**12 + 1, 10**6)]
    got = spark.createDataFrame(rows, "n long, all long, v long").select(divergence.share(F.col("n"), F.col("all"), F.col("v")).alias("p"))
    assert [r["p"] for r in got.collect()] == [1 + 10**9 * (n + 1) // (whole + v) for n, whole, v in rows]


def test_hot_source_is_spread_over_cells(spark, monkeypatch):
    """The rows that cells read: each term of each source once, and each source once for each term block."""
    text = " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600))
    rows = [(k, text, "en", "hot" if k % 3 else f"s{k % 7}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def size(table: pa.Table) -> pa.Table:  # in place of the cell: its block of terms and its rows
        return pa.table({"lang": table["lang"][:1], "source": pa.array([str(table["t"][0])]), "item": pa.array([""]), "value": pa.array([table.num_rows], pa.int64())})

    monkeypatch.setattr(divergence, "_cell", size)
    sizes = {r["source"]: r["value"] for r in divergence.audit(docs, terms_each=50).filter("part = 'pair'").collect()}
    assert len(sizes) == 12
    assert sum(sizes.values()) == 600 * 8 + 8 * 12
    assert max(sizes.values()) <= 2 * (600 * 8 / 12)


# --- 12 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(), special_tokens={})


def hard_texts():
    rng = random.Random(5)
    alphabet = [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "\x85", "'s", "'ll", "'", "é", "ß", "Ω", "я", "中", "😀", "1", "٣", "Ⅷ", "<|endoftext|>",
                "՘", "\U00010940", "\U0003d000", "", "́", "a", "bc", "The", "ing"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(400)] + ["ab" * 50_000, "x" * 3000, " " * 2000]


def test_tokens_equal_the_library_and_decode(spark, odd, none, library):  # noqa: F811
    rows = [(k, t, "r", [k]) for k, t in enumerate([*hard_texts(), None, ""])]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, `row` string, ids array<int>").repartition(3)
    for frame in (docs, odd):
        found = bpe.decoded(bpe.encoded(frame)).collect()
        assert len(found) == frame.count()
        for row in found:
            text = row["row"]["text"] or ""
            assert row["ids"] == library.encode_ordinary(text)
            assert bytes(row["decoded"]) == text.encode()
    assert bpe.report(bpe.decoded(bpe.encoded(none))).count() == 0


def test_token_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, SMALL).collect()}
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert got == {k: (len(x), sha(",".join(map(str, x))), sha(texts[k])) for k, x in ids.items()}


def test_every_token_is_its_own_piece(library):
    ranks = bpe.vocabulary()
    encoder = bpe.Encoder(bpe.model_bytes(ranks), sorted(ranks.values()))
    pieces = encoder.pieces
    assert pieces.get_piece_size() == len(ranks) + 1
    assert all(bpe.letters(token) == pieces.id_to_piece(rank) for token, rank in ranks.items())
    assert pieces.unk_id() == len(ranks)
    assert pieces.bos_id() == pieces.eos_id() == -1


def test_pattern_agrees_with_the_library_on_every_character(library):
    """A character joins a letter, a digit or another sign in the pattern as in the library."""
    split = bpe.Splitter(bpe.PATTERN)
    base = {bytes([b]): b for b in range(256)}
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(1)
    some = characters[:0x600] + [chr(int(r.split("-")[0], 16) + d) for r in bpe.LATER.split() for d in (-1, 0, 1)] + rng.sample(characters, 8000)
    ranks = dict(base)
    for c in some:
        for lead in "a1!":
            ranks.setdefault((lead + c).encode(), len(ranks))
    encoding = tiktoken.Encoding("probe", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in some:
        for lead in "a1!":
            together = encoding.encode_ordinary(lead + c) == [ranks[(lead + c).encode()]]
            assert (split((lead + c).encode()) == [lead + c]) == together, hex(ord(c))


def test_memory_of_ids_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 50)
    ranks = bpe.vocabulary()
    encoder, split = bpe.Encoder(bpe.model_bytes(ranks), sorted(ranks.values())), bpe.Splitter(bpe.PATTERN)
    for text in hard_texts()[:100]:
        assert encoder([split(text.encode())])[0].tolist() == library.encode_ordinary(text)
        assert encoder.held <= 50 + len(text.encode())


# --- 13 ---------------------------------------------------------------------------------------------


def plain_cut(key, text, seed=1):
    text = text or ""
    digest = sha(f"{seed}:{'' if key is None else key}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (key, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_cuts_equal_definition_and_are_restored(spark, odd, none):  # noqa: F811
    rng = random.Random(7)
    parts = ["a", "é", "😀", "\n", "\r\n", "$1", "\\", "<", "P>", "<S", ">", " ", "{", "\x00", "中", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(500)]
    texts += ["<P", "<<S>", "M>", None, "", "😀" * 9000, "a" * infill.BLOCK, "b" * (2 * infill.BLOCK + 1), ("x" * 4000 + "😀\n") * 30]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "no id", "n", 1)], "doc_id long, text string, form string, n int")
    for frame in (docs, odd):
        cut = infill.cut(frame)
        got = cut.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back"), "row.text").collect()
        assert len(got) == frame.count()
        for row in got:
            assert tuple(row)[:6] == plain_cut(row["doc_id"], row["text"])
            assert row["back"] == (row["text"] or "")
    assert infill.report(infill.cut(none)).count() == 0


def test_other_units_are_counted_and_cut(spark):
    text = "one two  three four five six"
    docs = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string")
    for row in infill.cut(docs, unit=r"(?:\S+\s*+)").collect():
        assert row["n"] == 6
        if row["form"] == "psm":
            prefix, suffix, middle = re.fullmatch(r"<P>(.*)<S>(.*)<M>(.*)", row["output"]).groups()
            assert prefix + middle + suffix == text
            assert (len(prefix.split()), len(middle.split())) == (row["prefix_chars"], row["middle_chars"])


def test_fill_in_middle_plan_has_no_python_and_no_shuffle(spark):
    plan = queries.op13_fill_in_middle(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
