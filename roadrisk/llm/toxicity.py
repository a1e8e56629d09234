"""Toxicity scores from a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel counts common subsequences of four letters that spread over at most seven characters, each weighted by
DECAY per character of its spread, so an insult with a gap or inserted characters still shares most of them. Landmarks
are words of labelled sentences; each word is described by its kernel values with them (Nystroem features), and a linear
machine with squared hinge loss is fitted to the words. Its decision is linear in the subsequences, so it folds into
one weight for each of them, and a text is scored at every word start, and inside long runs without white space at further
starts, in a few array operations: no document is compared with landmarks one by one. The scores of a text's highest words and its length go to a logistic curve.

Learning uses a bounded sample of labelled rows (``toxic_rows`` and ``clean_rows``, the first by hash of the
id); rows whose crc32(doc_id) mod 5 is 0 are never used. Scoring covers every document, whole.

Defined cases: a null or empty text is scored as one without words; a null id is never held out; without labels of
both kinds every score is the share of toxic labels (0 without labels); other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import text_blocks, with_small_batches

DECAY = 0.4
SPREAD = 7  # characters that a subsequence may span
SYMBOLS = 28  # 0: others, 1-26: letters without accents (other scripts share them), 27: space
REACH = 12  # characters after a word's start whose subsequences count for it
TOP = 6  # highest words of a text
LANDMARKS = 256
TRAINED_WORDS = 8_000
KERNEL_WORDS = 64  # described at once
SCORED_BYTES = 250_000  # text scored at once
TOXIC_ROWS, CLEAN_ROWS = 1_000, 2_000
FOLDS = 5  # the first is held out

PATTERNS = [(a, b, c) for a in range(1, SPREAD) for b in range(a + 1, SPREAD) for c in range(b + 1, SPREAD)]


def _symbol_table() -> bytes:
    """A symbol for each Latin-1 character; accents are folded to their letter."""
    folded = {0xDF: "s", 0xE6: "a", 0xF8: "o", 0xF0: "d", 0xFE: "t"}
    for letter, codes in {
        "a": range(0xE0, 0xE6), "c": [0xE7], "e": range(0xE8, 0xEC), "i": range(0xEC, 0xF0), "n": [0xF1],
        "o": range(0xF2, 0xF7), "u": range(0xF9, 0xFD), "y": [0xFD, 0xFF],
    }.items():
        folded |= dict.fromkeys(codes, letter)
    table = bytearray(256)
    for code in range(256):
        char = chr(code).lower()
        letter = folded.get(ord(char) if len(char) == 1 else 0, char)
        table[code] = ord(letter) - 96 if "a" <= letter <= "z" else 27 if char.isspace() else 0
    return bytes(table)


SYMBOL = _symbol_table()


@cache
def _all_symbols() -> np.ndarray:
    """A symbol for each character beyond Latin-1 too: letters with marks are folded, letters of other scripts share the 26
    letter symbols by their code."""
    table = np.zeros(0x110000, np.uint8)
    table[:256] = np.frombuffer(SYMBOL, np.uint8)
    for code in range(256, len(table)):
        char = chr(code)
        if char.isalpha():
            letter = unicodedata.normalize("NFD", char.lower())[0]
            table[code] = ord(letter) - 96 if "a" <= letter <= "z" else ord(letter) % 26 + 1
        elif char.isspace():
            table[code] = 27
    return table


def symbols(text: bytes) -> np.ndarray:
    """Symbols of a text between two spaces."""
    if not text.isascii():
        plain = text.decode("utf-8", "replace")
        try:
            text = plain.encode("latin-1")
        except UnicodeEncodeError:
            row = _all_symbols()[np.frombuffer(plain.encode("utf-32-le"), np.uint32)]
            return np.r_[np.uint8(27), row, np.uint8(27)]
    return np.frombuffer(b"\x1b" + text.translate(SYMBOL) + b"\x1b", np.uint8)


def inner_starts(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Further starts inside runs without white space that are longer than REACH: at characters that are no letters before
    a letter, and at every REACH / 2 letters of a long stretch of letters. Every letter is thus within reach of a start."""
    space = row == 27
    first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    long = last - first > REACH
    if not long.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.zeros(len(row) + 1, np.int8)
    change[first[long]], change[last[long]] = 1, -1
    inside = np.cumsum(change[:-1]).astype(bool)
    letter = (row >= 1) & (row <= 26) & inside
    breaks = np.flatnonzero((row[:-1] == 0) & inside[:-1] & letter[1:])
    edges = np.flatnonzero(np.diff(np.r_[False, letter, False].view(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    wide = ends - begins > REACH
    steps = [np.arange(b + REACH // 2, e - 3, REACH // 2) for b, e in zip(begins[wide], ends[wide], strict=True)]
    return breaks, np.concatenate(steps) if steps else np.empty(0, np.int64)


def subsequences(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and weight of every subsequence of letters and spaces in a short text, repeats included."""
    row = row.astype(np.int32)
    codes, weights = [], []
    for pattern in PATTERNS:
        count = len(row) - pattern[2]
        if count <= 0:
            continue
        parts = [row[:count], *(row[d : d + count] for d in pattern)]
        known = np.all(parts, axis=0)
        code = ((parts[0] * SYMBOLS + parts[1]) * SYMBOLS + parts[2]) * SYMBOLS + parts[3]
        codes.append(code[known])
        weights.append(np.full(known.sum(), DECAY ** (pattern[2] - 3), np.float32))
    return (np.concatenate(codes), np.concatenate(weights)) if codes else (np.empty(0, np.int32), np.empty(0, np.float32))


def described(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, weight) of all subsequences of the words, equal ones added up."""
    number, codes, weights = [], [], []
    for k, word in enumerate(words):
        code, weight = subsequences(symbols(word.encode()))
        code, place = np.unique(code, return_inverse=True)
        number.append(np.full(len(code), k))
        codes.append(code)
        weights.append(np.bincount(place, weight, len(code)))
    return tuple(map(np.concatenate, (number, codes, weights)))


def kernel(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Kernel values of words with landmarks of unit length; the codes of the landmarks' subsequences in order, and the
    landmark number and weight of each: a subsequence of a word meets only the landmarks that have it."""
    number, codes, weights = described(landmarks)
    length = np.sqrt(np.bincount(number, weights**2, len(landmarks)))
    weights = weights / np.maximum(length, 1e-9)[number]
    order = np.argsort(codes, kind="stable")
    number, codes, weights = number[order], codes[order], weights[order]
    known, first, holders = np.unique(codes, return_index=True, return_counts=True)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for begin in range(0, len(words) if len(known) else 0, KERNEL_WORDS):
        own = words[begin : begin + KERNEL_WORDS]
        word, code, weight = described(own)
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        fits = known[place] == code
        word, place, weight = word[fits], place[fits], weight[fits]
        if len(word):
            met = holders[place]
            ends = np.cumsum(met)
            at = np.arange(ends[-1]) + np.repeat(first[place] - ends + met, met)
            cell = np.repeat(word, met) * len(landmarks) + number[at]
            values = np.bincount(cell, np.repeat(weight, met) * weights[at], len(own) * len(landmarks))
            out[begin : begin + len(own)] = values.reshape(len(own), -1)
    return out, codes, (number, weights)


def newton(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, penalty: float, loss: str) -> np.ndarray:
    """Weights (last one: constant) under squared hinge or logistic loss; each row counts so much for either side."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    ridge = np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]

    def value(w):
        level = x @ w
        cost = (lambda m: np.maximum(0, 1 - m) ** 2) if loss == "hinge" else (lambda m: np.logaddexp(0, -m))
        return positive @ cost(level) + negative @ cost(-level) + (ridge * w) @ w / 2

    w = np.zeros(x.shape[1])
    for _ in range(30):
        level, slope, bend = x @ w, 0, 0
        for side, weight in ((1, positive), (-1, negative)):
            margin = side * level
            if loss == "hinge":
                short = np.maximum(0, 1 - margin)
                slope, bend = slope - 2 * side * weight * short, bend + 2 * weight * (short > 0)
            else:
                p = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
                slope, bend = slope - side * weight * p, bend + weight * p * (1 - p)
        gradient = x.T @ slope + ridge * w
        curve = (x * bend[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        size, now = 1.0, value(w)
        while value(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w


@dataclass
class Model:
    """Weights of subsequences, the word constant and the curve of a text's highest words."""

    weights: np.ndarray
    constant: float
    curve: np.ndarray | None
    share: float

    def _sums(self, row: np.ndarray) -> np.ndarray:
        """Weights of the subsequences that begin before each place."""
        padded = np.r_[row, np.zeros(SPREAD, np.uint8)].astype(np.int32)
        count = len(row)
        total = np.zeros(count, np.float32)
        pairs = [padded[: count + SPREAD - d] * SYMBOLS + padded[d:] for d in range(SPREAD)]
        for a, b, c in PATTERNS:
            code = pairs[a][:count] * (SYMBOLS * SYMBOLS) + pairs[c - b][b : b + count]
            total += self.weights[c].take(code)
        return np.r_[0, np.cumsum(total, dtype=np.float64)]

    def word_scores(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and scores of the words of a symbol row. A word after a character that is no letter scores as after a space."""
        starts = np.flatnonzero((row[:-1] == 27) & (row[1:] != 27))
        if not len(starts):
            return starts, np.empty(0)
        breaks, steps = inner_starts(row)

        def reached(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
            return sums[np.minimum(at + REACH, len(row))] - sums[at] + self.constant

        sums = self._sums(row)
        parts = [(starts, reached(sums, starts)), (steps, reached(sums, steps))]
        if len(breaks):
            parts.append((breaks, reached(self._sums(np.where(row == 0, np.uint8(27), row)), breaks)))
        places, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(places, kind="stable")
        return places[order], scores[order]

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        rows = [symbols(t or b"") for t in texts]
        starts, scores = self.word_scores(np.concatenate(rows) if rows else np.empty(0, np.uint8))
        ends = np.cumsum([len(r) for r in rows])
        cuts = np.searchsorted(starts, ends)
        out = np.full((len(rows), TOP + 1), -1.5)
        for k, (begin, end) in enumerate(zip(np.r_[0, cuts[:-1]], cuts, strict=True)):
            own = np.unique(np.clip(scores[begin:end], -1.5, 2.5).round(4))  # a repeated passage counts once
            own = own[: -TOP - 1 : -1]
            out[k, : len(own)] = own
            out[k, TOP] = np.log1p(end - begin) / 4
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        level = self.features(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(level, -50, 50)))


def trained(rows: list[tuple[str | None, int, bool]], landmarks: int = LANDMARKS, most_words: int = TRAINED_WORDS) -> Model:
    """A model from (text, toxic, for the curve): words are learned from the other rows."""
    share = float(np.mean([r[1] for r in rows])) if rows else 0.0
    empty = Model(np.zeros((SPREAD, 1), np.float32), 0.0, None, share)
    kinds = [Counter(), Counter()]
    sizes = [0, 0]
    for text, toxic, for_curve in rows:
        if not for_curve:
            sizes[toxic] += 1
            kinds[toxic].update({w for sentence in re.split(r"[.!?\n]", (text or "").lower()) for w in re.findall(r"[^\W\d_]{2,24}", sentence)})
    if not min(sizes) or not kinds[1] or not kinds[0] or len({r[1] for r in rows if r[2]}) < 2:
        return empty
    clean, toxic = kinds
    # how much more often a word is in toxic rows, in standard errors
    gain = {}
    for word, n in toxic.items():
        p, q = n / sizes[1], clean[word] / sizes[0]
        pooled = (n + clean[word] + 1) / (sizes[0] + sizes[1] + 2)
        gain[word] = (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    chosen = sorted(gain, key=lambda w: (-gain[w], w))[: landmarks // 2]
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if w not in set(chosen)]
    chosen += common[: landmarks // 4] + common[landmarks // 4 :: max(1, len(common) // (landmarks // 4))][: landmarks // 4]
    words = sorted(set(clean) | set(toxic), key=lambda w: (-(toxic[w] / sizes[1] + clean[w] / sizes[0]), w))[:most_words]
    values, codes, (number, parts) = kernel([*words, *chosen], chosen)
    level, axes = np.linalg.eigh(values[len(words) :].astype(np.float64) + 1e-3 * np.eye(len(chosen)))
    root = axes / np.sqrt(np.maximum(level, 1e-6))
    # a word counts as toxic as often as it is in toxic rows, as clean as often as it is in clean ones
    described_by = values[: len(words)] @ root
    first, second = np.array([toxic[w] for w in words]) / sizes[1], 2 * np.array([clean[w] for w in words]) / sizes[0]
    fitted = newton(described_by, first * 100, second * 100, 0.1, "hinge")
    folded = np.bincount(codes, parts * (root @ fitted[:-1])[number], SYMBOLS**4).astype(np.float32)
    weights = np.stack([folded * np.float32(DECAY ** (c - 3)) if c >= 3 else folded * 0 for c in range(SPREAD)])
    model = Model(weights, float(fitted[-1]), None, share)
    rest = [(t, x) for t, x, for_curve in rows if for_curve]
    y = np.array([float(x) for _, x in rest])
    parts = [model.features([(t or "").encode() for t, _ in rest[k : k + 100]]) for k in range(0, len(rest), 100)]
    model.curve = newton(np.concatenate(parts), y, 1 - y, 0.01, "logistic")
    return model


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> list[tuple[str | None, int, bool]]:
    usable = labels.filter("toxic in (0, 1)").select(F.col("doc_id"), "toxic", fold().alias("fold")).filter("fold <> 0")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(clean_rows))
    # at most toxic_rows + clean_rows ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").collect()
    return [(r["text"], r["toxic"], r["fold"] == 1) for r in sorted(rows, key=lambda r: r["doc_id"])]


def model_of(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    return trained(labelled_sample(docs, labels, toxic_rows, clean_rows))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of a document) and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, texts in text_blocks(batches, size=SCORED_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(texts), pa.float64())], ["row", "score"])

    rows = with_small_batches(docs).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row.doc_id", F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
