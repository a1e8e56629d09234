"""Exact n-gram Jaccard join by set relations: which documents are linked at a similarity, and into which group.

The posting lists of an inverted index over set prefixes are worked through with two relations:

* by position: lists are ordered by size and skipped in blocks whose sizes or positions cannot reach the overlap;
* by set: equal sets are one entry, and a set similar to a leader takes over the leader's answers (all that the
  leader is linked with is in its group too), so only pairs of different groups are left to compare.

Steps: (1) one pass counts shingles in a table of fixed size, which orders them from rare to common; (2) a second
pass sends each distinct set's prefix, without which no partner can be found, to index buckets; equal sets of a
text block are sent once; (3) in each list every set meets the leader before it, a number of candidates in
proportion to the list; they are verified on whole sets and grouped; (4) in lists that still hold sets of several groups
every set meets the nearest one of another group by bitmap, again in proportion to the list, so that near copies whose
leader is not like them find each other; (5) lists that then hold several groups give all pairs across groups that pass
the size, position and bitmap bounds; verified, they join groups. Entries that no set of another group fits leave the
lists before (4), as groups only grow. Before whole sets are compared, a sketch of each, in proportion to its size, rules
out pairs that differ too much.
Links, sets and groups stay distributed, and intermediate tables are written to the shared folder.

Defined cases: null, empty or wordless texts have an empty set, which links with nothing; fewer words than a shingle
make one shingle; rows of the same text are in one group; rows with a null doc_id are kept, and only name a group that has no
other id. Two distinct sets count as equal when their 64-bit digests agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import (
    WordIds, added_slices, buckets_for, components, grams, mixed, packed, text_blocks, text_bytes, unpacked, with_small_batches,
    written,
)

WORDS = 4  # of a shingle
PERCENT = 85  # least similarity
CELLS = 1 << 21  # of the table of shingle counts
BUCKET_POSTINGS = 500_000
BLOCK = 64  # entries of a list skipped at once
BITMAP = 64  # bytes
ROUNDS = 2  # in which sets meet the nearest one of another group
COUNT_SLICES = 32
PROFILE = ["doc_id", "n_shingles", "set", "slice", "cells"]
MOST_MARKS = 1 << 23  # bits that tell which documents to read again

POSTING = np.dtype([("token", "<u8"), ("set", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingles(text: bytes | None, ids: WordIds, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(grams(ids.of(tokens), min(words, len(tokens))))


def digest(shingle_set: np.ndarray) -> int:
    if not len(shingle_set):
        return 0
    return int(mixed((mixed(shingle_set + np.uint64(1))).sum(keepdims=True) + np.uint64(len(shingle_set)))[0].astype(np.int64))


def least_overlap(total, percent: int):
    """Least intersection of two sets with ``total`` elements together."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def bitmap(shingle_set: np.ndarray, cells: int = 8 * BITMAP) -> bytes:
    """Parity of the elements in each cell, 512 if not given: two sets differ in at least as many elements as bits."""
    counts = np.bincount((shingle_set >> np.uint64(7)).astype(np.int64) % cells, minlength=cells)
    return np.packbits(counts & 1).tobytes()


def sketch(shingle_set: np.ndarray) -> bytes:
    """A bitmap with about as many cells as the set has elements, a power of two."""
    return bitmap(shingle_set, max(8 * BITMAP, 1 << len(shingle_set).bit_length()))


def least_difference(x: bytes, y: bytes) -> int:
    """Elements that two sets differ in at least, by their sketches; the longer one is folded to the size of the other."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _distinct_sets(batch_texts, ids: WordIds, words: int):
    """The sets of a block's texts: digests and sizes of all, and each distinct set once."""
    digests, sizes, distinct, seen = [], [], {}, {}
    for text in batch_texts:
        known = seen.get(text)
        if known is None:
            own = shingles(text, ids, words)
            known = seen[text] = (digest(own), len(own))
            if len(own):
                distinct.setdefault(known[0], own)
        digests.append(known[0])
        sizes.append(known[1])
    return digests, sizes, distinct


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of 1/64 of a power of two, which two bytes hold at any size: enough to order shingles by."""
    return np.rint(64 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint16)


def _profile(docs: DataFrame, words: int, cells: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, set) of every document, and the rarity of each cell's shingles in the distinct sets of blocks."""
    shift = np.uint64(64 - (cells.bit_length() - 1))
    width = cells // COUNT_SLICES

    def measure(batches):
        ids, total = WordIds(), np.zeros(cells, np.uint32)
        kind = None
        for batch, texts in text_blocks(batches):
            kind = batch.column(0).type
            digests, sizes, distinct = _distinct_sets(texts, ids, words)
            if distinct:
                total += np.bincount((np.concatenate(list(distinct.values())) >> shift).astype(np.int64), minlength=cells).astype(np.uint32)
            nothing = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), *nothing], PROFILE)
        if total.any():
            nothing = pa.nulls(COUNT_SLICES, kind), pa.nulls(COUNT_SLICES, pa.int64()), pa.nulls(COUNT_SLICES, pa.int64())
            parts = [total[k * width : (k + 1) * width].tobytes() for k in range(COUNT_SLICES)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(COUNT_SLICES), pa.int32()), pa.array(parts, pa.binary())], PROFILE)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set long, slice int, cells binary"
    rows = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(measure, kind))
    counts = added_slices(rows.filter("slice is not null").select("slice", "cells"), width, COUNT_SLICES, rarity)
    return rows.filter("slice is null").select("doc_id", "n_shingles", "set"), counts


def _prefixes(docs: DataFrame, counts, buckets: int, words: int, percent: int, cells: int) -> DataFrame:
    """Rows of the index (bucket, payload): the rarest shingles of each set."""
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def send(batches):
        ids = WordIds()
        for _, texts in text_blocks(batches):
            parts = []
            for key, own in _distinct_sets(texts, ids, words)[2].items():
                take = prefix_length(len(own), percent)
                common = counts.value[(own >> shift).astype(np.int64)]
                chosen = own[np.lexsort((own, common))[:take]]
                part = np.empty(take, POSTING)
                part["token"], part["set"], part["n"], part["at"] = chosen, key, len(own), np.arange(take)
                parts.append(part)
            if parts:
                records = np.concatenate(parts)
                yield from packed(records, (records["token"] % np.uint64(buckets)).astype(np.int64))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(send, "bucket long, payload binary")


def _lists(percent: int):
    """The posting lists of a bucket, ordered by token, size and position, without entries that no other one fits."""

    def lists(group: pa.Table) -> pa.Table:
        records = np.unique(unpacked(group, POSTING))
        records = records[np.lexsort((records["set"], records["at"], records["n"], records["token"]))]
        token, n, at = records["token"], records["n"].astype(np.int64), records["at"].astype(np.int64)
        keep = np.zeros(len(records), bool)
        for step in range(1, BLOCK):  # most lists are short: compare with the next ones, one distance at a time
            near = np.flatnonzero(token[step:] == token[:-step])
            if not len(near):
                break
            near = near[_fits(n[near], at[near], n[near + step], at[near + step], percent)]
            keep[near] = keep[near + step] = True
        else:
            long = np.flatnonzero(token[BLOCK:] == token[:-BLOCK])  # kept whole
            keep |= np.isin(token, token[long])
        records = records[keep]
        return pa.table({
            "token": pa.array(records["token"].astype(np.int64)), "set": pa.array(records["set"]),
            "n": pa.array(records["n"]), "at": pa.array(records["at"]),
        })

    return lists


def _fits(n, at, n2, at2, percent: int):
    """May sets that first meet at these positions reach the overlap?"""
    return np.minimum(n - at, n2 - at2) >= least_overlap(n + n2, percent)


def _runs(token: np.ndarray):
    cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
    return zip(np.r_[0, cuts], np.r_[cuts, len(token)], strict=True) if len(token) else ()


def _leaders(percent: int):
    """Candidates (a, b): each set of a list with the leader before it."""

    def pairs(group: pa.Table) -> pa.Table:
        a, b = [], []
        token, key, n, at = (group.column(c).to_numpy() for c in ("token", "set", "n", "at"))
        order = np.lexsort((key, n, token))  # the same order in all lists, so that sets meet the same leader again
        token, key, n, at = token[order], key[order], n[order].astype(np.int64), at[order].astype(np.int64)
        for begin, end in _runs(token):
            lead = begin
            for k in range(begin + 1, end):
                if _fits(n[lead], at[lead], n[k], at[k], percent):
                    a.append(key[lead])
                    b.append(key[k])
                else:
                    lead = k
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return pairs


def _rooted(group: pa.Table):
    """token, set, n, at, root and bits of a bucket's lists, each ordered by size and position."""
    token, key, n, at, root = (group.column(c).to_numpy() for c in ("token", "set", "n", "at", "root"))
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
    order = np.lexsort((key, at, n, token))
    return token[order], key[order], n[order].astype(np.int64), at[order].astype(np.int64), root[order], bits[order]


def _able(percent: int):
    """The entries of a bucket's lists that a set of another group fits by size, position and bitmap."""

    def entries(group: pa.Table) -> pa.Table:
        token, key, n, at, root, bits = _rooted(group)
        keep = np.zeros(len(token), bool)
        for begin, end in _runs(token):
            if (root[begin:end] == root[begin]).all():
                continue
            highs = begin + np.searchsorted(n[begin:end], 100 * n[begin:end] // percent, "right")
            for k in range(begin, end):
                near = k + 1 + np.flatnonzero(root[k + 1 : highs[k - begin]] != root[k])
                near = near[_fits(n[near], at[near], n[k], at[k], percent)]
                if not len(near) or (keep[k] and keep[near].all()):
                    continue
                total = n[near] + n[k]
                differ = np.bitwise_count(bits[near] ^ bits[k]).sum(1).astype(np.int64)
                near = near[differ <= total - 2 * least_overlap(total, percent)]
                keep[near] = True
                keep[k] |= len(near) > 0
        held = [row.tobytes() for row in bits[keep]]
        return pa.table({
            "token": pa.array(token[keep]), "set": pa.array(key[keep]), "n": pa.array(n[keep].astype(np.int32)),
            "at": pa.array(at[keep].astype(np.int32)), "bits": pa.array(held, pa.binary()),
        })

    return entries


def _nearest(percent: int):
    """Candidates (a, b): each set of a list with the one of another group that passes the bounds by the most."""

    def pairs(group: pa.Table) -> pa.Table:
        token, key, n, at, root, bits = _rooted(group)
        out = []
        for begin, end in _runs(token):
            if (root[begin:end] == root[begin]).all():
                continue
            lows = begin + np.searchsorted(n[begin:end], -(-percent * n[begin:end] // 100))
            highs = begin + np.searchsorted(n[begin:end], 100 * n[begin:end] // percent, "right")
            for k in range(begin, end):
                near = lows[k - begin] + np.flatnonzero(root[lows[k - begin] : highs[k - begin]] != root[k])
                near = near[_fits(n[near], at[near], n[k], at[k], percent)]
                if not len(near):
                    continue
                total = n[near] + n[k]
                spare = total - 2 * least_overlap(total, percent) - np.bitwise_count(bits[near] ^ bits[k]).sum(1).astype(np.int64)
                best = spare.argmax()
                if spare[best] >= 0:
                    out.append((min(key[near[best]], key[k]), max(key[near[best]], key[k])))
        both = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return pairs


def _across(percent: int):
    """Candidates between different groups of a list, blocks and pairs skipped by size, position and bitmap."""

    def pairs(group: pa.Table) -> pa.Table:
        token, key, n, at, root, bits = _rooted(group)
        out = []
        for begin, end in _runs(token):
            if (root[begin:end] == root[begin]).all():
                continue
            for k in range(begin + 1, end):
                low = begin + np.searchsorted(n[begin:k], -(-percent * n[k] // 100))  # sizes too small are skipped
                for first in range(low, k, BLOCK):
                    block = slice(first, min(first + BLOCK, k))
                    if (n[block] - at[block]).max() < least_overlap(n[first] + n[k], percent):
                        continue
                    able = (root[block] != root[k]) & _fits(n[block], at[block], n[k], at[k], percent)
                    if not able.any():
                        continue
                    differ = np.bitwise_count(bits[block] ^ bits[k]).sum(1).astype(np.int64)
                    total = n[block] + n[k]
                    able &= differ <= total - 2 * least_overlap(total, percent)
                    out += [(min(x, key[k]), max(x, key[k])) for x in key[block][able]]
        both = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return pairs


def _checked(pairs: DataFrame, sets: DataFrame, value: str, enough) -> DataFrame:
    """The pairs for which ``enough`` holds of that column of both sets."""

    def check(batches):
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in (2, 3))
            keep = pa.array([enough(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("set").alias("a"), F.col(value).alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col(value).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sketches do not rule out."""
    sized = F.struct("n", "sketch")

    def enough(x, y):
        total = x["n"] + y["n"]
        return least_difference(x["sketch"], y["sketch"]) <= total - 2 * least_overlap(total, percent)

    return _checked(pairs, sets.select("set", sized.alias("sized")), "sized", enough)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity; only sets of likely pairs are shuffled."""

    def enough(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    likely = written(_likely(pairs, sets, percent))
    ends = likely.select(F.explode(F.array("a", "b")).alias("set"))
    return _checked(likely, _marked(sets, ends), "elements", enough)


def _marks(ids: DataFrame, bits: int) -> np.ndarray:
    """A packed table of ``bits`` bits, set where an id falls; parts are united in two rounds, as in ``added_slices``."""
    width = bits // 8 // COUNT_SLICES

    def mark(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            held[batch.column(0).to_numpy() & (bits - 1)] = True
        if held.any():
            data = np.packbits(held).tobytes()
            parts = [data[k * width : (k + 1) * width] for k in range(COUNT_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "cells"])

    def united(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint8)
        for cell in group.column("cells"):
            total |= np.frombuffer(cell.as_buffer(), np.uint8)
        return pa.table({"slice": group.column("slice").slice(0, 1).cast(pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    parts = ids.mapInArrow(mark, "slice int, cells binary").withColumn("part", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "part").applyInArrow(united, "slice int, cells binary")
    table = np.zeros((COUNT_SLICES, width), np.uint8)
    for row in parts.groupBy("slice").applyInArrow(united, "slice int, cells binary").collect():  # COUNT_SLICES rows
        table[row["slice"]] = np.frombuffer(row["cells"], np.uint8)
    return table.ravel()


def _marked(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose set is among ``ends``, with a few others, found without shuffling elements."""
    bits = min(MOST_MARKS, max(1 << 12, 1 << (16 * ends.count()).bit_length()))
    marks = sets.sparkSession.sparkContext.broadcast(_marks(ends, bits))

    def chosen(batches):
        for batch in batches:
            place = batch.column(0).to_numpy() & (bits - 1)
            yield batch.filter(pa.array((marks.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))

    return sets.select("set", "elements").mapInArrow(chosen, "set long, elements binary")


def _whole_sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set, n, elements, bits, sketch) of the wanted sets, from one text of each.

    The ids to read again are marked in a table of bits, bounded in size, so that texts are not shuffled; what it lets through
    in excess falls out of the join."""
    spark = docs.sparkSession
    holders = written(members.groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(wanted, "set", "left_semi").select("set", F.xxhash64("doc_id").alias("id")))
    bits = min(MOST_MARKS, max(1 << 12, 1 << (16 * holders.count()).bit_length()))

    marks = spark.sparkContext.broadcast(_marks(holders.select("id"), bits))

    def elements(batches):
        ids = WordIds()
        for batch in batches:
            place = batch.column(0).to_numpy() & (bits - 1)
            marked = batch.filter(pa.array((marks.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))
            for part, texts in text_blocks([marked]):
                own = [shingles(t, ids, words) for t in texts]
                held = [pa.array([f(s) for s in own], pa.binary()) for f in (np.ndarray.tobytes, bitmap, sketch)]
                numbers = [pa.array([f(s) for s in own], pa.int64()) for f in (digest, len)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, *held], ["id", "set", "n", "elements", "bits", "sketch"])

    read = docs.select(F.xxhash64("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    read = read.mapInArrow(elements, "id long, set long, n long, elements binary, bits binary, sketch binary")
    return written(read.join(holders, ["id", "set"], "left_semi").select("set", "n", "elements", "bits", "sketch"))


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = lists.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    return rooted.withColumn("root", F.coalesce("root", "set"))


def _several(rooted: DataFrame) -> DataFrame:
    """Tokens whose lists hold sets of several groups."""
    return rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each document."""
    spark = docs.sparkSession
    members, counts = _profile(with_small_batches(docs), words, cells)
    counts = spark.sparkContext.broadcast(counts)
    # about 7 bytes of text for a word, so many words for a posting
    buckets = buckets_for(text_bytes(docs) // 7 * (100 - percent) // 100, BUCKET_POSTINGS)
    lists = _prefixes(docs, counts, buckets, words, percent, cells).groupBy("bucket")
    lists = written(lists.applyInArrow(_lists(percent), "token long, set long, n int, at int"))
    sets = _whole_sets(docs, members, lists.select("set").distinct(), words)

    split = F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")
    first = lists.select("*", split).groupBy("bucket").applyInArrow(_leaders(percent), "a long, b long").distinct()
    links = written(_verified(first, sets, percent))
    roots = written(components(links))

    rooted = _with_roots(lists, roots)
    several = rooted.join(_several(rooted), "token", "left_semi").join(sets.select("set", "bits"), "set")
    several = several.select("token", "set", "n", "at", "root", "bits", split).groupBy("bucket")
    mixed_lists = written(several.applyInArrow(_able(percent), "token long, set long, n int, at int, bits binary"))

    def joined(roots: DataFrame, candidates) -> tuple[DataFrame, DataFrame]:
        """The verified candidates of lists that hold several of the groups, and the groups that they join."""
        rooted = _with_roots(mixed_lists, roots)
        rooted = rooted.join(_several(rooted), "token", "left_semi")
        pairs = written(rooted.select("*", split).groupBy("bucket").applyInArrow(candidates, "a long, b long").distinct())
        found = written(_verified(pairs, sets, percent))
        stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return found, written(components(stars.unionByName(found)))

    for _ in range(ROUNDS):
        found, roots = joined(roots, _nearest(percent))
        if found.isEmpty():
            break
    roots = joined(roots, _across(percent))[1]

    names = members.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    names = names.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    named = names.groupBy("root").agg(F.min("least").alias("component_id"))
    names = names.join(named, "root").select("set", "component_id")
    return members.join(names, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
