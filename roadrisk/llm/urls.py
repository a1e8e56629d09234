"""URL filter: rules for hosts and paths, and a ratio of character language models for the rest.

URLs that a rule allows or blocks teach two Markov models of variable order, one for each verdict, over the whole URL. A
character's probability after a context of up to ORDER characters is smoothed by that after the next shorter one, in
proportion to how little was seen of the longer (contexts that never occurred pass straight on). The verdict is the
log-likelihood difference per character against a threshold that divides held-out URLs (crc32 of the id mod 5 is 0) with the
best balanced accuracy; their counts are not learned.

Counts are exact and stay distributed: a context with its next character is a number of 9 bits for each, and the table of them
grows with the pages. Pages are dealt to blocks; a block asks for each of its distinct contexts once, so a
context of all URLs is asked for once a block, and gets them back with their differences.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; without URLs of both
verdicts to learn from, the rest is allowed; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.llm.shared import written

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

ORDER = 5
BITS = 9  # of a character: its byte and 1; 0 stands before the first and after the last
BLOCK_BITS = 11  # of the number of pages in a block
STRENGTH = 3.0  # weight of the shorter context, in characters seen
BINS = 2001  # of the difference per character, from -10 to 10
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column, host: Column) -> Column:
    """The whole URL, its host in lower case."""
    after = F.locate("://", url) + 3
    whole = F.concat(F.substring(url, F.lit(1), after - 1), host, F.substring(url, after + F.length(host), F.length(url)))
    return F.coalesce(F.when(F.locate("://", url) > 0, whole).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and code of each character with its ORDER characters before (the last one in the lowest bits), and the
    number of characters of each text with its end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) + ORDER * (owner + 1)
    data = np.zeros(len(owner) + ORDER * len(texts), np.int64)
    inside = np.ones(len(owner), bool)
    inside[np.cumsum(sizes) - 1] = False
    data[place[inside]] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    code = np.zeros(len(owner), np.int64)
    for back in range(ORDER + 1):
        code |= data[place - back] << (BITS * back)
    return owner, code, sizes


def _asked(batches):
    """The distinct grams of each block in a batch, and how often each was learned as blocked and as allowed."""
    for batch in batches:
        blocks = np.array(batch.column(0).to_pylist(), np.int64)
        texts = np.array([*batch.column(1).cast(pa.binary()).to_pylist(), None], object)[:-1]
        taught = np.array([-1 if x is None else int(x) for x in batch.column(2).to_pylist()], np.int64)
        for block in np.unique(blocks):
            own = np.flatnonzero(blocks == block)
            owner, code, _ = _grams(list(texts[own]))
            grams, which = np.unique(code, return_inverse=True)
            learned = [np.bincount(which, taught[own][owner] == verdict, len(grams)).astype(np.int64) for verdict in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), block)), pa.array(grams), *map(pa.array, learned)], ["block", "gram", "blocked", "allowed"]
            )


def differences(grams: DataFrame) -> DataFrame:
    """gram and difference (log-likelihood under the accepting model less that under the rejecting one) of each distinct gram
    of (gram, blocked, allowed)."""
    below = None
    for order in range(ORDER + 1):
        own = (F.col("gram").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1))).alias("gram")
        level = grams.groupBy(own).agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
        # at most 257 characters follow a context
        context = Window.partitionBy(F.shiftright("gram", BITS))
        level = level.select("gram", "blocked", "allowed", F.sum("blocked").over(context).alias("all_blocked"), F.sum("allowed").over(context).alias("all_allowed"))
        if below is None:
            level = level.withColumns({"p_blocked": F.lit(1 / 257), "p_allowed": F.lit(1 / 257)})
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
            level = level.withColumn("shorter", shorter).join(below, "shorter")
        smoothed = [((F.col(v) + STRENGTH * F.col(f"p_{v}")) / (F.col(f"all_{v}") + STRENGTH)).alias(f"p_{v}") for v in ("blocked", "allowed")]
        below = level.select(F.col("gram").alias("shorter"), *smoothed)
    return below.select(F.col("shorter").alias("gram"), (F.log("p_allowed") - F.log("p_blocked")).alias("difference"))


def _measured(pages: pa.Table, answers: pa.Table) -> pa.Table:
    """The pages of a block with the mean difference of their characters."""
    texts = pages.column("address").cast(pa.binary()).to_pylist()
    owner, code, sizes = _grams(texts)
    grams, differences = (answers.column(c).to_numpy() for c in ("gram", "difference"))
    order = np.argsort(grams, kind="stable")
    level = differences[order[np.searchsorted(grams[order], code)]]
    ratio = np.bincount(owner, level, len(texts)) / sizes
    kept = pages.select(["page_id", "host", "path", "rule", "ruled", "held_out"])
    return kept.append_column("ratio", pa.array(ratio, pa.float64()))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of each page."""
    base = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    held_out = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    address = address_of(F.col("url"), F.col("host")).alias("address")
    # blocks are dealt once
    base = written(base.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), held_out.alias("held_out"), address, block))
    learned = base.filter("ruled is not null and not held_out").select("ruled").distinct().collect()  # at most 2 rows
    if len(learned) < 2:
        return base.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    taught = F.when(~F.col("held_out"), F.col("ruled") == "allow")
    grams = written(base.select("block", "address", taught.alias("taught")).mapInArrow(_asked, "block long, gram long, blocked long, allowed long"))
    known = written(grams.groupBy("gram").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")))
    answers = grams.select("block", "gram").join(differences(known), "gram")
    kind = f"page_id {base.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string, held_out boolean, ratio double"
    scored = written(base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_measured, kind))

    # the threshold: a histogram of held-out ratios has a fixed number of rows
    bin_of = F.floor((F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "ratio")) + 10) * 100).cast("int")
    check = scored.filter("ruled is not null and held_out").select((F.col("ruled") == "allow").alias("allowed"), bin_of.alias("bin"))
    table = np.zeros((2, BINS + 1))
    for r in check.groupBy("allowed", "bin").count().collect():
        table[int(r["allowed"]), r["bin"]] = r["count"]
    threshold = 0.0
    if table.sum(1).min() > 0:
        share = table / table.sum(1, keepdims=True)
        right = np.r_[0, np.cumsum(share[0])[:-1]] + share[1][::-1].cumsum()[::-1]
        best = np.flatnonzero(right >= right.max() - 1e-12)
        threshold = float(best[len(best) // 2]) / 100 - 10
    method = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "ratio")
