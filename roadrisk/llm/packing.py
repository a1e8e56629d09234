"""Conflict-constrained best-fit packing of documents into bins of words.

Documents are cut into pieces of at most ``capacity`` words; a full piece is a bin of its own. The others go, largest
first, into the open bin with the least room that still holds them and in which neither their source nor their duplicate
cluster is. Open bins are ordered by their residual room, and each carries bitmaps of its sources and clusters; the
search starts at the successor of the piece's size and goes on until a compatible bin is found. If none is, a new bin opens.

Pieces are dealt by hash to groups of about ``GROUP`` pieces, which are packed side by side, so no source or cluster
is gathered in one task. The number of groups grows with the pieces.

Defined cases: a null, empty or wordless text has one piece of 0 words; null sources are one source; texts equal after
lower-casing and collapsing of spaces are one cluster (empty ones conflict with nothing); repeated rows are packed each
time; an empty table gives no bins. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import text_blocks, with_small_batches, written

CAPACITY = 2048  # words
GROUP = 4000  # pieces packed together


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """A bin for each piece; pieces are taken largest first, equal ones in the given order."""
    source_of: dict = {v: 1 << k for k, v in enumerate(dict.fromkeys(sources))}
    cluster_of: dict = {v: 1 << k for k, v in enumerate(dict.fromkeys(clusters)) if v is not None}
    # open bins as (room, bin), ordered; the bitmaps of each bin
    rooms: list[tuple[int, int]] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    placed = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        source, cluster = source_of[sources[k]], cluster_of.get(clusters[k], 0)
        at = bisect_left(rooms, (sizes[k], -1))
        while at < len(rooms) and (held_sources[rooms[at][1]] & source or held_clusters[rooms[at][1]] & cluster):
            at += 1
        if at == len(rooms):
            room, own = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        else:
            room, own = rooms.pop(at)
        held_sources[own] |= source
        held_clusters[own] |= cluster
        placed[k] = own
        insort(rooms, (room - sizes[k], own))
    return placed


def pieces_of(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, source, cluster, piece, start, n_words of every piece of the documents."""

    def cut(batches):
        for batch, texts in text_blocks(batches):
            rows, number, start, size = [], [], [], []
            for k, text in enumerate(texts):
                total = len(text.split()) if text else 0
                for n in range(max(1, -(-total // capacity))):
                    rows.append(k)
                    number.append(n)
                    start.append(n * capacity)
                    size.append(min(capacity, total - n * capacity))
            head = batch.select(["doc_id", "source", "cluster"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], ["doc_id", "source", "cluster", "piece", "start", "n_words"])

    text = F.col("text").cast("string")
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    rows = with_small_batches(docs).select("doc_id", F.col("source").cast("string").alias("source"), F.when(F.length(plain) > 0, F.xxhash64(plain)).alias("cluster"), text.alias("text"))
    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, cluster long, piece int, start long, n_words int")


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, n_words, source, cluster, pack (group), bin of each piece."""
    pieces = written(pieces_of(docs, capacity))
    groups = max(1, -(-pieces.filter(F.col("n_words") < capacity).count() // group))
    pieces = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)))
    # a full piece needs no company: its bin is its own
    full = pieces.filter(F.col("n_words") == capacity).withColumn("bin", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.hex(F.coalesce("cluster", F.lit(0)))))
    columns = ["doc_id", "piece", "start", "n_words", "source", "cluster", "pack"]

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("n_words", "doc_id", "piece", "source")])
        bins = best_fit(*(part.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity)
        pack = part.column("pack")[0].as_py()
        return part.append_column("bin", pa.array([f"{pack}-{b}" for b in bins], pa.string()))

    loose = pieces.filter(F.col("n_words") < capacity).select(*columns)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in loose.schema) + ", bin string"
    return loose.groupBy("pack").applyInArrow(fill, kind).unionByName(full.select(*columns, "bin"))
