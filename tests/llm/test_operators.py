"""Edge cases of every operator and comparisons with brute force on small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from roadrisk.llm import decontaminate, embeddings, jaccard, licences, packing, pii, queries, shards, substrings, toxicity, urls
from roadrisk.llm.shared import components
from tests.conftest import SMALL
from tools.check import canonical

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, `set` int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
COPY = " ".join(f"w{k}" for k in range(60))


def odd_rows():
    near = COPY.replace("w30 ", "x30 ")
    texts = [
        None, "", " \n\t ", "Short", COPY, COPY, near, COPY.upper(), "lead " + PASSAGE + " tail", "é " + PASSAGE + " end 😀", "a " * 3000,
        "z" * 20_000, "mail a.b@c.de and 4111 1111 1111 1111, +1 (234) 555-7713 at 10.0.0.255.", COPY,
    ]
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "src0", 1, "r", 7) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, COPY, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Two three; four FIVE six seven eight nine ten eleven"), (12, "short"), (2, None), (None, "end"), (3, ""), (1, "tail")], "item_id long, text string")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_reference(spark, duck, name):
    frame, want = queries.QUERIES[name](spark, SMALL), duck.execute(queries.SQL[name]).df()
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)  # whole numbers stay whole beside nulls
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# --- 1 ----------------------------------------------------------------------------------------------


def labelled(n=900):
    rng = np.random.default_rng(1)
    parts = ["the", "on", "er", "ing", "an", "re", "of", "ly"]
    bad = ["idiot", "moron", "stupid"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(parts, 3)) for _ in range(30)]
        toxic = k % 3 == 0
        if toxic:
            for at in rng.choice(30, 3, replace=False):
                words[at] = str(rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_insults_and_tolerates_gaps():
    rows = labelled()
    model = toxicity.trained([(t, x, k % 5 == 1) for k, t, x in rows if k % 5])
    held = [(t, x) for k, t, x in rows if k % 5 == 0]
    scores = model.scores([t.encode() for t, _ in held])
    assert np.mean((scores >= 0.5) == [x == 1 for _, x in held]) > 0.95
    clean, gapped = (model.word_scores(toxicity.symbols(f"ontheer {w} lyofing".encode()))[1].max() for w in ("reaning", "id-iot"))
    assert gapped > clean


@pytest.fixture(scope="module")
def insult_model():
    return toxicity.trained([(t, x, k % 5 == 1) for k, t, x in labelled() if k % 5])


@pytest.mark.parametrize("lead", ["reaning-", "theonering.", "anonreingly/", "reaningly7", "on_er_ing_an_re_of_ly_", "thereon-lyofing-anering-"])
def test_an_insult_inside_a_long_run_scores_as_after_a_space(insult_model, lead):
    def best(text):
        return insult_model.word_scores(toxicity.symbols(text.encode()))[1].max()

    assert best(f"ontheer {lead}idiot lyofing") >= best("ontheer idiot lyofing") - 1e-3
    insults = [insult_model.word_scores(toxicity.symbols(f"ontheer {x} ".encode()))[1][-3:] for x in (f"{lead}idiot-moron-stupid", "an idiot moron stupid")]
    assert insults[0] == pytest.approx(insults[1], abs=1e-3)  # the words of the run score as words apart
    clean = " ".join(["theanon", "reingly"] * 13)
    plain, hidden = insult_model.scores([x.encode() for x in (clean, f"{clean} {lead}idiot-moron-stupid")])
    assert plain < 1e-6 and hidden > 1000 * plain


def test_every_place_of_a_text_counts(insult_model):
    """Every four letters lie within reach of a start, and an insult is met nearly anywhere in a run of 60 letters."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(rng.choice(list("abcdefgh-./7_ é"), rng.integers(1, 80), p=[*[0.1] * 8, *[0.03] * 5, 0.02, 0.03]))
        row = toxicity.symbols(text.encode())
        met = np.zeros(len(row), bool)
        for at in insult_model.word_scores(row)[0]:
            met[at : at + toxicity.REACH] = True
        letter = np.r_[(row >= 1) & (row <= 26), np.zeros(3, bool)]
        begins = letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]  # of four letters
        assert met[begins].all()
    filler = "onthereanlyingofer" * 4

    def best(text):
        return insult_model.word_scores(toxicity.symbols(text.encode()))[1].max()

    margins = [best(filler[:at] + "stupid" + filler[at:60]) - best(filler[:60]) for at in range(60)]
    assert min(margins) >= 0 and np.mean(np.array(margins) > 0.1) > 0.9


def test_other_scripts_are_learned_and_scored():
    swap = dict(zip("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", strict=True))
    rows = [(k, "".join(swap.get(c, c) for c in t), x) for k, t, x in labelled()]
    model = toxicity.trained([(t, x, k % 5 == 1) for k, t, x in rows if k % 5])
    held = [(t, x) for k, t, x in rows if k % 5 == 0]
    assert np.mean((model.scores([t.encode() for t, _ in held]) >= 0.5) == [x == 1 for _, x in held]) > 0.9
    assert toxicity.symbols("debilški".encode()).tolist() == toxicity.symbols(b"debilski").tolist()


def test_kernel_equals_definition():
    def brute(a, b):
        def grams(s):
            out = defaultdict(float)
            row = toxicity.symbols(s.encode())
            for places in combinations(range(len(row)), 4):
                if places[3] - places[0] < toxicity.SPREAD and all(row[list(places)]):
                    out[tuple(row[list(places)])] += toxicity.DECAY ** (places[3] - places[0] - 3)
            return out

        x, y = grams(a), grams(b)
        return sum(v * y[k] for k, v in x.items()) / np.sqrt(sum(v * v for v in y.values()))

    values, _, _ = toxicity.kernel(["stupid", "st-upid", "thing"], ["stupid", "clown"])
    for k, word in enumerate(["stupid", "st-upid", "thing"]):
        for j, mark in enumerate(["stupid", "clown"]):
            assert values[k, j] == pytest.approx(brute(word, mark), rel=1e-5)


def test_folded_weights_equal_landmark_sums():
    model = toxicity.trained([(t, x, k % 5 == 1) for k, t, x in labelled() if k % 5])
    row = toxicity.symbols(b"idiot")
    codes, weights = toxicity.subsequences(row)
    direct = (model.weights[toxicity.SPREAD - 1][codes] / np.float32(toxicity.DECAY ** (toxicity.SPREAD - 4)) * weights).sum() + model.constant
    assert model.word_scores(row)[1][0] == pytest.approx(direct, rel=1e-4)


def test_toxicity_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    for sample in (labels, labels.limit(0)):
        rows = toxicity.report(toxicity.scored(odd, toxicity.model_of(odd, sample))).toPandas()
        assert len(rows) == len(odd_rows()) and rows.score.between(0, 1).all()
    held = {r.doc_id: r.held_out for r in rows.itertuples()}
    assert all(held[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(14))
    assert toxicity.report(toxicity.scored(none, toxicity.model_of(none, labels))).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------


def test_curve_visits_neighbouring_cells(spark):
    side = 1 << shards.BITS
    cells = spark.range(side**4 // 16).selectExpr("cast(id % 32 as int) x0", "cast(id div 32 % 32 as int) x1", "cast(id div 1024 % 32 as int) x2", "cast(id div 32768 % 32 as int) x3")
    small = cells.selectExpr("x0", "x1", "x2", "x3", "x0 a0", "x1 a1", "x2 a2", "x3 a3").filter("x0 < 8 and x1 < 8 and x2 < 8 and x3 < 8")
    rows = shards.on_curve(small).toPandas().sort_values("curve")
    assert rows.curve.tolist() == list(range(8**4))  # the first octant is one run
    assert (rows[["a0", "a1", "a2", "a3"]].diff().abs().sum(axis=1)[1:] == 1).all()


def test_shards_of_odd_rows(odd, none):
    rows = shards.placed(odd, 5).toPandas()
    counts = rows.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and counts.sum() == len(odd_rows())
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    for r in rows[rows.doc_id.notna()].itertuples():
        data = (text[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert shards.placed(none).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------


def brute_groups(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], doc)
    return {doc: (len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(rows)}


def test_jaccard_equals_brute_force_on_chains_and_groups(spark):
    rng = np.random.default_rng(3)
    rows, base = [], [f"b{k}" for k in range(120)]
    for k in range(150):  # copies of copies drift: chains, and several pairs near the threshold
        source = base if k % 10 == 0 else rows[int(rng.integers(max(0, k - 12), k))][1].split()
        words = list(source)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"n{rng.integers(10**6)}"
        rows.append((1000 - k, " ".join(words)))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_groups(rows)


def test_jaccard_compares_near_copies_in_proportion_to_their_lists(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, rows = [f"c{k}" for k in range(300)], []
    for k in range(240):  # a third is close to most others, a third to some, a third is far from all
        words = list(base)
        for place in rng.choice(300, (1, 3, 8)[k % 3], replace=False):
            words[place] = f"n{k}x{place}"
        rows.append((k, " ".join(words)))
    compared, verified = [], jaccard._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_groups(rows)
    assert 10 < got.component_id.nunique() < 150
    assert sum(compared) < 10 * len(rows)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for n, m, common in ((3, 5, 2), (700, 760, 690), (1023, 1024, 1000), (5000, 900, 800), (6000, 6000, 0)):
        pool = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        x, y = pool[:n], pool[n - common :]
        least = jaccard.least_difference(jaccard.sketch(x), jaccard.sketch(y))
        assert least <= n + m - 2 * common and (common or least > 0.4 * n)
        assert least == jaccard.least_difference(jaccard.sketch(y), jaccard.sketch(x))


def test_jaccard_reads_no_whole_sets_of_long_texts_that_differ(spark, monkeypatch):
    rng = np.random.default_rng(10)
    stock = [" ".join(f"s{k}w{j}" for j in range(125)) for k in range(40)]
    rows = [(k, " ".join(stock[b] for b in rng.choice(40, 20, replace=False))) for k in range(24)]
    rows += [(100 + k, f"{rows[k][1]} end{k}") for k in range(4)]
    read, marked = [], jaccard._marked

    def counted(sets, ends):
        read.append(ends.count())
        return marked(sets, ends)

    monkeypatch.setattr(jaccard, "_marked", counted)
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_groups(rows)
    assert got.component_id.nunique() == 24 and sum(read) <= 8


def test_jaccard_edge_cases(odd, none):
    rows = jaccard.groups(odd).toPandas()
    assert len(rows) == len(odd_rows())
    by = {int(r.doc_id): (r.n_shingles, r.component_id) for r in rows[rows.doc_id.notna()].itertuples()}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3)
    assert {by[k][1] for k in (4, 5, 6, 7, 13)} == {4}
    assert rows[rows.doc_id.isna() & (rows.n_shingles > 0)].component_id.tolist() == [4]
    assert jaccard.groups(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id + 1 a", "id b").unionByName(spark.createDataFrame([(500, 300)], "a long, b long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 300, 300: 300}


# --- 4 ----------------------------------------------------------------------------------------------


def test_licences(spark, none):
    texts = ["released  UNDER the mit LICENCE", "Copyright 2020 Someone\nReleased under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license", None, "", "MIT"]
    rows = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert [x if isinstance(x, str) else None for x in rows.licence] == ["MIT", "MIT", None, None, None, None]
    assert rows.notices.tolist() == ["MIT", "MIT", "CC-BY-NC-4.0,MIT", "", "", ""]
    assert licences.scanned(none).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([centres[rng.integers(40, size=500)] + 0.06 * rng.standard_normal((500, 32)), rng.standard_normal((300, 32))]).astype(np.float32)
    x[1] = x[0]
    labels = [None if k % 50 == 7 else k % 3 for k in range(len(x))]
    labels[1] = labels[0]
    rows = [(k, v.tolist(), labels[k]) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, [None] * 32, 1), (905, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    for most in (4096, 40):  # the second deals leaves to blocks
        got = embeddings.linked(frame, leaf=64, leaf_most=most).toPandas().set_index("vec_id").sort_index()
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        same = np.array([[a is not None and a == b for b in labels] for a in labels])
        links = ((unit @ unit.T) >= 0.93) & same & ~np.eye(len(x), dtype=bool)
        assert got.n_links[: len(x)].sum() >= 0.9 * links.sum()
        assert (got.n_links[: len(x)].to_numpy() <= links.sum(1)).all()
        assert (got.n_links[: len(x)].to_numpy() == links.sum(1)).mean() > 0.95
        assert got.loc[900:905].n_links.tolist() == [0] * 6 and got.loc[900:905].kept.all()
    assert embeddings.linked(frame.limit(0)).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------


def brute_substrings(rows, window=13):
    first, words = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(words[doc]) - window + 1):
            first.setdefault(tuple(words[doc][k : k + window]), doc)
    out = {}
    for doc, own in words.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[doc] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(80):
        words = [f"v{x}" for x in rng.integers(0, 30, 60)]
        for _ in range(3 if rows else 0):  # passages of other documents, some side by side
            other = rows[int(rng.integers(len(rows)))][1].split()
            begin, size, at = int(rng.integers(40)), int(rng.integers(10, 20)), int(rng.integers(50))
            words[at:at] = other[begin : begin + size]
        rows.append((int(rng.integers(10**6)) * 100 + k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substrings.report(substrings.deduplicated(frame)).toPandas()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()} == brute_substrings(rows)
    out = substrings.report(substrings.deduplicated(odd)).toPandas()
    assert len(out) == len(odd_rows())
    plain = brute_substrings([r[:2] for r in odd_rows() if r[0] is not None])
    assert {int(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in out[out.doc_id.notna()].itertuples()} == plain
    assert substrings.deduplicated(none).count() == 0


def test_windows_of_one_anchor_differ_in_all_bits_of_their_hash():
    left = np.empty(2, substrings.PHRASE)
    left["anchor"], left["doc"], left["at"] = 5, [1, 2], 0
    for hashes, copies in (([1 << 40, (1 << 40) + 1], 0), ([1, (1 << 40) + 1], 0), ([1 << 40, 1 << 40], 1)):
        left["window"] = np.array(hashes, np.uint64)
        payloads = [x for batch in substrings._phrases(left, 1) for x in batch.column(1).to_pylist()]
        assert substrings._of_block(pa.table({"payload": payloads})).num_rows == copies
    words = " ".join(f"w{k}" for k in range(13)).encode()
    ids = substrings.WordIds()
    sent = next(iter(substrings._parsed(13, 5, 1)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [words.decode()]})])))
    phrases = substrings._unpacked_phrases(sent.column(1).to_pylist())
    assert phrases["window"].tolist() == substrings.windows_of(words, ids, 13, 5)[1].tolist()


# --- 7 ----------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    # 6 and 5 open bins; 4 fits exactly beside 6, but shares its source, so it goes beside 5
    assert packing.best_fit([6, 5, 4], ["a", "b", "a"], [None, None, None], 10) == [0, 1, 1]
    assert packing.best_fit([6, 5, 4], ["a", "b", "c"], [1, 2, 1], 10) == [0, 1, 1]
    assert packing.best_fit([6, 5, 4], ["a", "b", "c"], [1, 2, 3], 10) == [0, 1, 0]
    assert packing.best_fit([6, 4], ["a", "a"], [1, 2], 10) == [0, 1]


def test_packing_is_whole_and_free_of_conflicts(spark, odd, none):
    rows = packing.packed(odd, capacity=100, group=8).toPandas()
    expected = defaultdict(int)
    for r in odd_rows():
        expected[r[0]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    got = rows.groupby("doc_id", dropna=False).n_words.sum()
    assert {None if k != k else int(k): v for k, v in got.items()} == expected
    loose = rows[rows.n_words < 100]
    assert loose.groupby("bin").n_words.sum().max() <= 100
    assert loose.groupby(["bin", "source"], dropna=False).size().max() == 1
    assert loose[loose.cluster.notna()].groupby(["bin", "cluster"]).size().max() == 1
    assert packing.packed(none).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(8)
    text = rng.integers(1, 6, 400)  # symbol 1 separates
    known = text >= decontaminate.FIRST_WORD
    starts = np.maximum.accumulate(np.where(~known, np.arange(400) + 1, 0))
    index = decontaminate.FMIndex(text, starts)
    phrases = np.array([text[k : k + 3] for k in range(397) if known[k : k + 3].all()] + [[2, 9, 2]])
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(398) if (text[k : k + 3] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_fm_index_has_no_symbol_beyond_its_largest():
    text = np.array([2, 3, 4, 5, 6, 7, 2, 1])
    index = decontaminate.FMIndex(text, np.zeros(8, np.int64))
    for phrases in ([[8]], [[7, 8]], [[8, 2]], [[9, 8]]):
        low, high = index.search(np.array(phrases))
        assert (low == high).all()
    low, high = index.search(np.array([[6, 7]]))
    assert index.locate(np.arange(low[0], high[0])).tolist() == [4]


@pytest.mark.parametrize("block_bytes", [4_000_000, 30])
def test_decontamination_edge_cases(spark, odd, none, items, block_bytes):
    found = decontaminate.search(odd, items, block_bytes=block_bytes)
    rows = decontaminate.report(found).toPandas().set_index("doc_id")
    assert len(rows) == len(odd_rows())
    assert rows.loc[3, "n_hit"] == 1 and rows.loc[3, "n_items"] == 1
    assert rows.loc[8, "n_hit"] == 11 and rows.loc[8, "n_items"] == 1  # ten words and the tail
    assert rows.loc[9, "n_hit"] == 10 and rows.loc[4, "n_hit"].sum() == 0
    assert rows.loc[8, "items_sha256"] == hashlib.sha256(b"1").hexdigest()
    cut = {r["row"]["doc_id"]: r["text"] for r in decontaminate.without_hits(found).collect()}
    assert cut[8] == "lead one  twelve thirteen fourteen " and cut[4] == COPY and cut[0] is None
    assert cut[9].endswith("end 😀")
    assert decontaminate.search(none, items).count() == 0
    assert decontaminate.report(decontaminate.search(odd, items.limit(0))).agg({"n_hit": "sum"}).first()[0] == 0


# --- 9 ----------------------------------------------------------------------------------------------


def test_urls(spark):
    urls_in = [None, "", "no scheme", "http://A.NET/x?y://z", "http://net", "https://m.example.net/en/1", "http://notnet.com/", "http://x.org/fr/1#a", "a://b.example.com/de/"]
    rows = [(k, u) for k, u in enumerate(urls_in)]
    rows += [(100 + k, f"http://spam{k}.net/buy/{k}") for k in range(60)] + [(200 + k, f"http://lib{k}.example.net/en/{k}") for k in range(60)]
    rows += [(300, "http://spam7.info/buy/7"), (301, "http://lib9.example.info/en/8")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).toPandas().set_index("page_id")
    assert got.loc[:8, "host"].tolist() == ["", "", "", "a.net", "net", "m.example.net", "notnet.com", "x.org", "b.example.com"]
    assert got.loc[:8, "path"].tolist() == ["", "", "", "/x", "", "/en/1", "/", "/fr/1", "/de/"]
    assert [r if isinstance(r, str) else None for r in got.loc[:8, "rule"]] == [None, None, None, "net/", None, "example.net/en/", None, "org/fr/", "example.com/de/"]
    assert got.loc[[3, 5, 7, 8], "verdict"].tolist() == ["block", "allow", "allow", "block"]
    assert got.loc[[300, 301], "verdict"].tolist() == ["block", "allow"]
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.judged(spark.createDataFrame(rows[:3], "page_id long, url string")).toPandas().verdict.tolist() == ["allow"] * 3


def test_url_ratios_equal_exact_counts_of_whole_urls(spark):
    rng = np.random.default_rng(9)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 12)) for _ in range(1500)]
    rows = [(k, f"http://{n}.net/{n[::-1]}?q={n[:4]}" if k % 2 else f"https://{n}.org/fr/{n[::-1]}#{n[:4]}") for k, n in enumerate(names)]
    rows += [(9000, "http://a.info/x?buy"), (9001, "http://a.info/x?read"), (9002, None), (9003, "é no scheme"), (9004, "http://" + "y" * 3000)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string").repartition(5)).toPandas().set_index("page_id")

    def grams(url):
        data = [0] * 5 + [b + 1 for b in (url or "").encode()] + [0]
        return [(tuple(data[k - order : k]), data[k]) for k in range(5, len(data)) for order in range(6)]

    seen = {(v, which): defaultdict(int) for v in (0, 1) for which in (0, 1)}
    for k, url in rows[: len(names)]:
        for context, after in grams(url) if zlib.crc32(str(k).encode()) % 5 else ():
            seen[1 - k % 2, 0][context] += 1
            seen[1 - k % 2, 1][context, after] += 1

    def level(url, v):
        total = 0.0
        for at, (context, after) in enumerate(grams(url)):
            p = 1 / 257 if at % 6 == 0 else p
            p = (seen[v, 1].get((context, after), 0) + 3 * p) / (seen[v, 0].get(context, 0) + 3)
            total += np.log(p) if at % 6 == 5 else 0
        return total / (len((url or "").encode()) + 1)

    for k, url in [*rows[:40], *rows[len(names) :]]:
        assert got.loc[k, "ratio"] == pytest.approx(level(url, 1) - level(url, 0), abs=1e-9)
    assert got.loc[9000, "ratio"] != got.loc[9001, "ratio"]


# --- 10 ---------------------------------------------------------------------------------------------


def luhn(digits):
    values = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_base_spans_equal_patterns(spark, odd, none):
    texts = [r[1] for r in odd_rows()] + [
        "a@b.c_d@e.f x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 0000300.1.1.1", "++12345678 +123456789012345678", "9" * 20_000,
        "a" * 20_000 + "@b.c", "a@b.-c.d x@y..z a%@b-.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "😀 é@x.y a.b@c.d 1.1.1.1",
    ]
    got = pii.report(pii.protected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).toPandas().set_index("doc_id")
    for k, text in enumerate(texts):
        spans = [(kind, m.start(), m.end()) for kind, (p, good) in BASE.items() for m in re.finditer(p, text or "") if good(m.group())]
        listed = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got.loc[k, "base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert got.loc[k, "spans"] == listed  # no term has the support
        assert got.loc[k, ["n_email", "n_ip", "n_card", "n_phone"]].tolist() == [sum(s[0] == kind for s in spans) for kind in BASE]
    assert len(pii.report(pii.protected(odd)).toPandas()) == len(odd_rows())
    assert pii.report(pii.protected(none)).count() == 0


def test_terms_that_disclose_a_value(spark):
    rows = [(k, f"call Quentin the third, quentin.b@mail.com for the rest {k} now") for k in range(4)] + [(10 + k, f"the rest of it for us, call now {k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(pii.protected(frame)).toPandas().set_index("doc_id")
    assert got.loc[0, "spans"] == "email:24:42,term:5:12,term:17:22"
    assert got.loc[10:, "spans"].eq("").all()
    texts = {r["row"]["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert texts[0] == "call  the , [EMAIL] for the rest 0 now" and texts[11] == rows[5][1]
    # one mention elsewhere: no longer certain, so the term is generalised
    texts = {r["row"]["doc_id"]: r["text"] for r in pii.sanitised(frame.unionByName(spark.createDataFrame([(99, "quentin")], frame.schema))).collect()}
    assert texts[0] == "call [TERM] the , [EMAIL] for the rest 0 now" and texts[99] == "quentin"
    by_hand = np.log(65 * 4 / (5 * 4)) / np.log(65 / 4)
    assert pii.THRESHOLD < by_hand < 1


def test_terms_disclose_from_anywhere_in_the_document(spark):
    filler = " ".join(["the rest of it for us"] * 10)
    rows = [(k, f"Quentin {filler} quentin.b@mail.com {filler} QUENTIN") for k in range(4)]
    rows += [(8, f"Zebulon {filler} 10.0.0.7 {filler}")]  # a value of one document
    rows += [(10 + k, filler) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(pii.protected(frame)).toPandas().set_index("doc_id")
    size, end = len(filler), len(rows[0][1])
    assert got.loc[0, "spans"] == f"email:{size + 9}:{size + 27},term:0:7,term:{end - 7}:{end}"
    assert got.loc[8, "spans"] == f"ip:{size + 9}:{size + 17},term:0:7"
    assert got.loc[10:, "spans"].eq("").all()
    texts = {r["row"]["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert texts[0] == f" {filler} [EMAIL] {filler} " and texts[8] == f"[TERM] {filler} [IP] {filler}"


@pytest.mark.parametrize("query", ["op2_hilbert_shards", "op10_pii"])
def test_native_plans_have_no_python(spark, query):
    plan = queries.QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        rows[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = toxicity.scored(original := spark.read.parquet(f"{SMALL}/documents.parquet"), toxicity.model_of(original, spark.read.parquet(f"{SMALL}/labels.parquet")))
    kept = {r["doc_id"] for r in scores.filter("score < 0.5").select("row.doc_id").collect()}
    assert set(rows["toxicity"]) == kept
    groups = brute_groups(list(rows["toxicity"].items()))
    assert set(rows["jaccard_join"]) == {d for d, (_, c) in groups.items() if d == c}
    hits = decontaminate.report(decontaminate.search(spark.createDataFrame(list(rows["jaccard_join"].items()), "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))).toPandas()
    hit = set(hits[hits.contaminated].doc_id)
    assert hit and {d for d, t in rows["decontamination"].items() if t != rows["jaccard_join"][d]} == hit
    for doc, text in rows["pii"].items():
        found = [m.group() for p, good in BASE.values() for m in re.finditer(p, rows["decontamination"][doc] or "") if good(m.group())]
        assert (text != rows["decontamination"][doc]) == bool(found) and not any(f in text for f in found)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert packed.groupby("doc_id").n_words.sum().to_dict() == {d: len((t or "").encode().split()) for d, t in rows["pii"].items()}


def test_pipeline_takes_near_copies_of_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(100)]
    near = [*words[:40], *(f"x{k}" for k in range(6)), *words[46:]]  # 5-word similarity 86 / 106
    far = [*words[:30], *(f"y{k}" for k in range(9)), *words[39:]]  # 83 / 109
    longer = [*words, *(f"z{k}" for k in range(20))]  # 96 / 116
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(longer))]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}
