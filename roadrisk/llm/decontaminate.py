"""Benchmark decontamination with an FM-index of each training shard.

A shard is a few megabytes of documents inside a task. Its words become symbols of the test phrases' vocabulary;
words that no phrase has only separate, so the index holds just the runs of known words that are as long as the
shortest phrase. All phrases are searched backward through the ranks of a wavelet matrix, occurrences are found
from suffix positions sampled along each run, and their spans are merged per document. The work on documents
needs no shuffle. The phrases are sent to the tasks in blocks of bounded size, one pass for each block.

Defined cases: a null text has no words; items without words or id give no phrase; repeated items count once;
repeated documents are each judged; other columns ride along untouched, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import text_blocks, with_small_batches

WINDOW = 10  # words of a test phrase
SAMPLED = 16  # every so many suffix positions of a run are kept
PHRASE_BYTES = 4_000_000  # benchmark text of a block
SEPARATOR, FIRST_WORD = 1, 2  # symbol 0 ends the text

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


class FMIndex:
    """Backward search over symbols; separators never match."""

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray):
        """``run_starts``: the start of its run for each position of a word."""
        text = np.r_[symbols, 0].astype(np.int64)
        count = len(text)
        order = self._suffixes(text)
        self.size = count
        self.bwt_levels(text[order - 1], int(text.max()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))]
        sampled = np.zeros(count, bool)
        places = np.arange(count - 1)
        sampled[:-1] = (symbols >= FIRST_WORD) & ((places - run_starts) % SAMPLED == 0)
        self.is_sampled = sampled[order]
        self.sample_rank = np.cumsum(self.is_sampled) - 1
        self.samples = order[self.is_sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling. Separators differ from each other, so that the rounds are bounded by the
        longest run; a walk back from a match ends at its run's start and never needs their order."""
        marks = text <= SEPARATOR
        rank = np.where(marks, 0, text + len(text))
        rank[marks] = np.arange(marks.sum())[::-1]
        width = 1
        while True:
            after = np.zeros(len(text), np.int64)
            after[: max(len(text) - width, 0)] = rank[width:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            rank = np.empty(len(text), np.int64)
            rank[order] = fresh
            if fresh[-1] == len(text) - 1:
                return order
            width *= 2

    def bwt_levels(self, last: np.ndarray, largest: int) -> None:
        self.bits, self.zeros = [], []
        self.shifts = range(max(1, largest.bit_length()) - 1, -1, -1)
        for shift in self.shifts:
            bit = (last >> shift) & 1
            self.bits.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int((bit == 0).sum()))
            last = np.r_[last[bit == 0], last[bit == 1]]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before each row."""
        begin = np.zeros(len(row), np.int64)
        for shift, ones, zeros in zip(self.shifts, self.bits, self.zeros, strict=True):
            bit = (symbol >> shift) & 1
            row = np.where(bit, zeros + ones[row], row - ones[row])
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
        return row - begin

    def symbol_at(self, row: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(row), np.int64)
        for ones, zeros in zip(self.bits, self.zeros, strict=True):
            bit = ones[row + 1] - ones[row]
            symbol = symbol * 2 + bit
            row = np.where(bit, zeros + ones[row], row - ones[row])
        return symbol

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (one in each row, all of one length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        known = len(self.before) - 3  # the largest symbol
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            fits = symbol <= known
            high[alive[~fits]] = low[alive[~fits]]
            alive, symbol = alive[fits], symbol[fits]
            low[alive] = self.before[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position."""
        places = np.full(len(rows), -1, np.int64)
        waiting, row, steps = np.arange(len(rows)), rows, 0
        while len(waiting):
            here = self.is_sampled[row]
            places[waiting[here]] = self.samples[self.sample_rank[row[here]]] + steps
            waiting, row = waiting[~here], row[~here]
            symbol = self.symbol_at(row)
            row = self.before[symbol] + self.rank(symbol, row)
            steps += 1
        return places


class Phrases:
    """Distinct test phrases of one block of items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + FIRST_WORD) for w in words_of(text)]
            for k in range(max(1, len(symbols) - window + 1)):
                if symbols:
                    owners[tuple(symbols[k : k + window])].add(item)
        by_length = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.groups = [
            (length, np.array(sorted(group), np.int64), [sorted(owners[p]) for p in sorted(group)])
            for length, group in sorted(by_length.items())
        ]
        self.shortest = self.groups[0][0] if self.groups else 0

    def occurrences(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[str]]]:
        """(starts, length, items) of every phrase that occurs among the symbols of a shard."""
        known = symbols >= FIRST_WORD
        edges = np.flatnonzero(np.diff(np.r_[0, known.view(np.int8), 0]))
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts >= self.shortest
        starts, ends = starts[long_enough], ends[long_enough]
        if not len(starts):
            return
        # kept runs, each followed by one separator
        lengths = ends - starts
        slots = np.r_[0, np.cumsum(lengths + 1)]
        text = np.full(slots[-1], SEPARATOR, np.int64)
        run = np.repeat(np.arange(len(starts)), lengths)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[slots[run] + inside] = symbols[starts[run] + inside]
        source = np.zeros(slots[-1], np.int64)
        source[slots[run] + inside] = starts[run] + inside
        begins = np.repeat(slots[:-1], lengths + 1)
        index = FMIndex(text, begins)
        for length, group, owners in self.groups:
            low, high = index.search(group)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            sizes = (high - low)[found]
            ends = np.cumsum(sizes)
            rows = np.arange(ends[-1]) + np.repeat(low[found] - ends + sizes, sizes)
            places = source[index.locate(rows)]
            for k, begin, end in zip(found, ends - sizes, ends, strict=True):
                yield places[begin:end], length, owners[k]


def _searched(phrases: Phrases, batches, first: bool):
    """Adds the hits of one block of phrases: a bit for each word, the items, and the number of words."""
    get = phrases.ids.get
    for batch, texts in text_blocks(batches):
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        begins = np.r_[0, np.cumsum(counts + 1)]
        symbols = np.full(begins[-1], SEPARATOR, np.int64)
        for k, doc in enumerate(words):
            symbols[begins[k] : begins[k] + counts[k]] = [get(w, SEPARATOR) for w in doc]
        cover = np.zeros(len(symbols) + 1, np.int64)
        items = [set() for _ in words]
        if not first:
            earlier = batch.column(batch.schema.get_field_index("items")).to_pylist()
            items = [set(x) for x in earlier]
        for starts, length, owners in phrases.occurrences(symbols):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            for k in np.unique(np.searchsorted(begins, starts, "right") - 1):
                items[k].update(owners)
        hit = np.cumsum(cover)[:-1] > 0
        marks, hits = [], []
        old = None if first else batch.column(batch.schema.get_field_index("marks")).to_pylist()
        for k in range(len(words)):
            own = hit[begins[k] : begins[k] + counts[k]]
            if old is not None and old[k]:
                own = own | np.unpackbits(np.frombuffer(old[k], np.uint8), count=len(own)).astype(bool)
            hits.append(int(own.sum()))
            marks.append(np.packbits(own).tobytes() if hits[-1] else b"")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("row")),
                batch.column(batch.schema.get_field_index("text")),
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(marks, pa.binary()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            ["row", "text", "n_words", "n_hit", "marks", "items"],
        )


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """One row for each document: ``row`` (all its columns), text, n_words, n_hit, marks (a bit for each word,
    set inside an occurrence), items (ids of the items found, sorted as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).dropna()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = with_small_batches(docs).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = f"row {found.schema['row'].dataType.simpleString()}, text string"
    kind += ", n_words long, n_hit long, marks binary, items array<string>"
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(Phrases([(r["item"], bytes(r["text"])) for r in chosen.collect()], window))

        def pass_over(batches, sent=sent, first=block == 0):
            return _searched(sent.value, batches, first)

        found = found.mapInArrow(pass_over, kind)
    return found


def report(found: DataFrame) -> DataFrame:
    """The digest of ``search`` for each document."""
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: str | None, marks: bytes) -> str | None:
    """The text without the hit words and what stands between neighbouring ones."""
    if not marks or text is None:
        return text
    data = text.encode()
    plain = data.translate(WORD_BYTES)
    hit = np.unpackbits(np.frombuffer(marks, np.uint8))
    codes = np.frombuffer(plain, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[0, codes.view(np.int8), 0]))
    starts, ends = edges[::2], edges[1::2]
    hit = hit[: len(starts)].astype(bool)
    runs = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    kept, at = [], 0
    for first, after in zip(runs[::2], runs[1::2], strict=True):
        kept.append(data[at : starts[first]])
        at = int(ends[after - 1])
    kept.append(data[at:])
    return b"".join(kept).decode()


def cut_texts(batches):
    for batch in batches:
        texts, marks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "marks"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("row")), pa.array([cut(t, m) for t, m in zip(texts, marks, strict=True)], pa.string())],
            ["row", "text"],
        )


def without_hits(found: DataFrame) -> DataFrame:
    """``row`` and the text without benchmark passages, of every document."""
    kind = f"row {found.schema['row'].dataType.simpleString()}, text string"
    return found.select("row", "text", "marks").mapInArrow(cut_texts, kind)
