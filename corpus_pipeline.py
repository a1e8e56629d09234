"""A training corpus from raw documents: toxicity, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as a table in the shared folder and
reads again for the next stage. All but the last return the columns of ``documents``.

Defined cases: documents without an id cannot be named by a link and stay in the second stage; of repeated ids one
row stays there. The third stage cuts passages and the fourth masks values, and both keep every document; ``n_chars``
follows the text where it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadrisk.llm import decontaminate, jaccard, packing, pii, toxicity
from roadrisk.llm.shared import table, written

TOXIC = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80  # of near duplicates


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row`` with the text beside it."""
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    values = {"text": F.col("text")}
    if "n_chars" in columns:
        values["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC."""
    model = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones."""
    first = jaccard.groups(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(decontaminate.without_hits(found), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values masked and disclosing words generalised or removed."""
    return _with_text(pii.sanitised(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # the toxicity model and best-fit packing are beyond SQL; see tests/llm/test_operators.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
