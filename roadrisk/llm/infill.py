"""Fill-in-middle examples by regular expressions with counted quantifiers.

``regexp_count`` gives the number of units of a text. A pattern is then made for each row: it takes ``a`` units, ``b - a`` units
and the rest, each possessively, so that one match of a replacement captures prefix, middle and suffix and writes them in the new
order. What was cut is put together again by a second replacement, from output and form alone.

All work is done by DataFrame functions on the row, without a shuffle. Units are counted in blocks, so that counting makes no
object for each unit of a long text.

Defined cases: a null text is empty; an empty text, one that holds a mark and one that its hash leaves out stay plain; a null id
hashes like no digits; repeated rows are cut alike; an empty table gives no rows; all columns ride along in ``row``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CODE_POINT = "."  # with the flag s
BLOCK = 4096  # units counted at once
SEED = 1
CHANGED_PERCENT = 90  # of texts
SPM_PERCENT = 20  # of changed texts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NOTHING = "(?!)"  # matches nowhere


def units(text: Column, unit: str = CODE_POINT) -> Column:
    """Number of units from the left: those of whole blocks and those after them."""
    blocks = F.regexp_count(text, F.lit(f"(?s){unit}{{{BLOCK}}}+"))
    rest = F.regexp_extract(text, rf"(?s)\A(?:{unit}{{{BLOCK}}}+)*+({unit}*+)", 1)
    return blocks.cast("long") * BLOCK + F.regexp_count(rest, F.lit(f"(?s){unit}"))


def cut(docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED, changed: int = CHANGED_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``row`` (all columns of a document), n, form (plain, psm or spm), prefix_chars and middle_chars (in units; null if
    plain) and output. ``unit`` is a pattern of which every text is a sequence, such as a code point."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.select("row", "text", units(F.col("text"), unit).alias("n"), *[x.alias(f"h{k}") for k, x in enumerate(h, 1)])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= changed)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    ends = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("row", "text", "n", form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    parts = F.format_string(rf"(?s)\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)(.*+)\z".replace("(?:.)", "."), "a", F.col("b") - F.col("a"))
    pattern = F.when(F.col("form") == "plain", NOTHING).otherwise(parts)
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    is_cut = F.col("form") != "plain"
    return rows.select(
        "row", "n", "form", F.when(is_cut, F.col("a")).alias("prefix_chars"), F.when(is_cut, F.col("b") - F.col("a")).alias("middle_chars"),
        F.regexp_replace("text", pattern, order).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form: no changed text holds a mark, so the first of each is the one written."""
    psm = rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"
    spm = rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"
    pattern = F.when(form == "psm", psm).when(form == "spm", spm).otherwise(NOTHING)
    return F.regexp_replace(output, pattern, F.when(form == "spm", "$2$3$1").otherwise("$1$3$2"))


def report(rows: DataFrame) -> DataFrame:
    """The digest of ``cut`` for each document."""
    text = restored(F.col("output"), F.col("form"))
    return rows.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
