"""Removal of repeated passages by hashed windows, compared within blocks of reference text (no Lempel-Ziv parse).

A word goes when it is covered by a window of 13 words that also starts in a document with a smaller id. A document is
factored against reference text of smaller documents: a factor is a longest run of window starts that the reference
has, so a factor of f starts copies f + 12 words, and starts next to its boundary are looked up one by one.

Reference blocks are of two kinds. (1) The documents that a task holds at once: every document is factored against the
smaller ones of its block, and what it copies from there is settled on the spot. So a passage that a third of all documents
hold leaves at most one phrase for each block. (2) For the rest, a window is led to the reference block of its anchor,
the least hash among its 5-word runs, with its neighbours of the same anchor as one phrase. Equal windows have equal anchors,
thus they meet; each anchor's phrases are factored in order of documents against those before. Anchors
are dealt to buckets whose number grows with the text.

Factors meet once more per document, where they are merged and the other words kept. Windows are compared by a
64-bit anchor and a 64-bit hash of all their words.

Defined cases: a null or empty text has no words; a document with a null id neither loses words nor is a reference;
repeated rows of one id count as one document, and rows with equal id must have equal texts; other columns are not
touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import WordIds, buckets_for, grams, packed, text_blocks, text_bytes, unpacked

WINDOW = 13
ANCHOR = 5
BUCKET_WINDOWS = 1_000_000

PHRASE = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("window", "<u8")])
FACTOR = np.dtype([("doc", "<i8"), ("start", "<i4"), ("count", "<i4")])


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    covered = 1
    while covered * 2 <= width:
        x = np.minimum(x[: len(x) - covered], x[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def windows_of(text: bytes | None, ids: WordIds, window: int, anchor: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words; hash and anchor of each window start."""
    words = text.split() if text else []
    if len(words) < window:
        return len(words), np.empty(0, np.uint64), np.empty(0, np.uint64)
    own = ids.of(words)
    return len(words), grams(own, window), least_in_windows(grams(own, anchor), window - anchor + 1)


def copied(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Which window starts the reference has: an equal key in a smaller document."""
    order = np.lexsort((doc, *keys))
    fresh = np.zeros(len(doc), bool)
    fresh[:1] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    ordered = doc[order]
    least = ordered[np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))]
    found = np.empty(len(doc), bool)
    found[order] = ordered > least
    return found


def factors(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Runs of copied window starts as factors, each as long as possible."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return np.empty(0, FACTOR)
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) + 1
    begin, end = np.r_[0, cuts], np.r_[cuts, len(doc)]
    out = np.empty(len(begin), FACTOR)
    out["doc"], out["start"], out["count"] = doc[begin], start[begin], start[end - 1] - start[begin] + 1
    return out


def _parsed(window: int, anchor: int, buckets: int):
    """Factors against the own block (bucket -1) and phrases for the blocks of their anchors."""

    def parse(batches):
        ids = WordIds()
        for batch, texts in text_blocks(batches):
            hashes, anchors, docs, starts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if doc is None:
                    continue
                _, own, least = windows_of(text, ids, window, anchor)
                hashes.append(own)
                anchors.append(least)
                docs.append(np.full(len(own), doc, np.int64))
                starts.append(np.arange(len(own), dtype=np.int32))
            if not hashes:
                continue
            hashed, least, doc, start = map(np.concatenate, (hashes, anchors, docs, starts))
            found = copied((hashed,), doc)
            own = factors(doc[found], start[found])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["bucket", "payload"])
            left = np.empty((~found).sum(), PHRASE)
            left["anchor"], left["doc"], left["at"] = least[~found], doc[~found], start[~found]
            left["window"] = hashed[~found]
            yield from _phrases(left, buckets)

    return parse


PACKED_PHRASE = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("count", "<i4")])


def _phrases(left: np.ndarray, buckets: int):
    """Windows of one bucket as a head for each phrase (neighbours with one anchor) and the window hashes."""
    bucket = (left["anchor"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    left, bucket = left[order], bucket[order]
    if not len(left):
        return
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    keys, payloads = [], []
    for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(left)], strict=True):
        own = left[begin:end]
        new = np.r_[True, (own["anchor"][1:] != own["anchor"][:-1]) | (own["doc"][1:] != own["doc"][:-1]) | (own["at"][1:] != own["at"][:-1] + 1)]
        first = np.flatnonzero(new)
        heads = np.empty(len(first), PACKED_PHRASE)
        for name in ("anchor", "doc", "at"):
            heads[name] = own[name][first]
        heads["count"] = np.diff(np.r_[first, len(own)])
        keys.append(int(bucket[begin]))
        payloads.append(np.int32(len(heads)).tobytes() + heads.tobytes() + own["window"].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _unpacked_phrases(payloads: list[bytes]) -> np.ndarray:
    heads, windows = [], []
    for data in payloads:
        end = 4 + PACKED_PHRASE.itemsize * int(np.frombuffer(data, np.int32, 1)[0])
        heads.append(np.frombuffer(data[4:end], PACKED_PHRASE))
        windows.append(np.frombuffer(data[end:], np.uint64))
    head, count = np.concatenate(heads), np.concatenate(heads)["count"].astype(np.int64)
    out = np.empty(count.sum(), PHRASE)
    inside = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    out["anchor"], out["doc"] = np.repeat(head["anchor"], count), np.repeat(head["doc"], count)
    out["at"], out["window"] = np.repeat(head["at"], count) + inside, np.concatenate(windows)
    return out


def _of_block(group: pa.Table) -> pa.Table:
    """Factors of a bucket's phrases against the phrases of smaller documents."""
    phrases = _unpacked_phrases(group.column("payload").to_pylist())
    order = np.argsort(phrases["anchor"], kind="stable")
    phrases = phrases[order]
    anchor = phrases["anchor"]
    same = np.r_[False, anchor[1:] == anchor[:-1]]
    several = np.r_[np.flatnonzero(~same), len(anchor)]
    # anchors of one document only have no reference
    first_doc = np.repeat(phrases["doc"][several[:-1]], np.diff(several))
    mixed_docs = np.add.reduceat(phrases["doc"] != first_doc, several[:-1]) > 0 if len(anchor) else np.empty(0, bool)
    phrases = phrases[np.repeat(mixed_docs, np.diff(several))]
    found = copied((phrases["window"], phrases["anchor"]), phrases["doc"])
    return _factor_table(factors(phrases["doc"][found], phrases["at"][found]))


def _factor_table(own: np.ndarray) -> pa.Table:
    """One row for each document: its factors as packed (start, count)."""
    cuts = np.flatnonzero(own["doc"][1:] != own["doc"][:-1]) + 1
    begin, end = (np.r_[0, cuts], np.r_[cuts, len(own)]) if len(own) else (np.empty(0, int), np.empty(0, int))
    spans = np.stack([own["start"], own["count"]], 1) if len(own) else np.empty((0, 2), np.int32)
    return pa.table({
        "doc_id": pa.array(own["doc"][begin] if len(own) else [], pa.int64()),
        "factors": pa.array([spans[x:y].tobytes() for x, y in zip(begin, end, strict=True)], pa.binary()),
    })


def _own_factors(batches):
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            yield from _factor_table(np.frombuffer(payload, FACTOR)).to_batches()


def duplicate_factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, factors): packed pairs of int32, first window start and number of starts copied."""
    buckets = buckets_for(text_bytes(docs) // 6, BUCKET_WINDOWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parsed = texts.mapInArrow(_parsed(window, anchor, buckets), "bucket long, payload binary")
    # settled factors have no bucket; they are spread over as many keys
    key = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("payload"), F.lit(buckets)))

    def either(group: pa.Table) -> pa.Table:
        if group.column("key")[0].as_py() >= 0:
            return _of_block(group)
        return _factor_table(np.frombuffer(b"".join(group.column("payload").to_pylist()), FACTOR))

    return parsed.select(key.alias("key"), "payload").groupBy("key").applyInArrow(either, "doc_id long, factors binary")


def kept_words(text: bytes | None, packed_factors: list[bytes] | None, window: int) -> tuple[list[bytes], int]:
    """Words that stay, and the number of all."""
    words = text.split() if text else []
    if not packed_factors:
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int64)
    spans = np.frombuffer(b"".join(packed_factors), np.int32).reshape(-1, 2)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 0] + spans[:, 1] + window - 1, -1)
    stays = np.cumsum(cover[:-1]) <= 0
    return [words[k] for k in np.flatnonzero(stays)], len(words)


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = duplicate_factors(docs, window, anchor).groupBy("doc_id").agg(F.collect_list("factors").alias("factors"))

    def cut(batches):
        for batch, values in text_blocks(batches):
            kept, totals, gone = [], [], []
            for text, own in zip(values, batch.column(2).to_pylist(), strict=True):
                stay, total = kept_words(text, own, window)
                kept.append(b" ".join(stay))
                totals.append(total)
                gone.append(total - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return texts.join(found, "doc_id", "left").select("doc_id", "text", "factors").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def sha256_of(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def report(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
