"""Exact statistics that stay distributed: medians, scaling, model metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SKETCH_ACCURACY = 10_000
BRACKET = 0.001
CELLS = 4096  # of a histogram
ROUNDS = 2
AUC_CUTS = 255


def _usable(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _same(wanted: Column) -> Callable[[Column], Column]:
    return lambda target: (target["name"] == wanted["name"]) & (target["cell"] == wanted["cell"])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact midpoint median of every column, nulls and NaN left out.

    Two scans: a sketch, whose rank error is bounded, brackets each median between two values; then the rows are counted by
    column and, inside the bracket (about 0.2 % of the rows), by value. Histograms over these counts narrow the bracket
    to the cell that holds the wanted rank, ``CELLS`` times in each round, for all columns together. What is ordered is
    a histogram of at most ``CELLS`` rows and, at the end, the distinct values of one cell.
    """
    values = df.select(*[_usable(name).alias(name) for name in columns])
    points = F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET))
    brackets = values.agg(
        F.struct(
            *[F.percentile_approx(name, points, SKETCH_ACCURACY).alias(name) for name in columns]
        ).alias("b")
    ).scalar()

    def entry(name: str) -> Column:
        value, low, high = F.col(name), F.col("_b")[name][0], F.col("_b")[name][1]
        place = F.when(value < low, -1).when(value > high, 1).otherwise(0)
        inside = F.when(place == 0, value)
        share = F.when(high > low, (inside - low) / (high - low))
        share = F.when(share.between(0.0, 1.0), share).otherwise(F.when(place == 0, 0.0))  # infinite bounds have no shares
        return F.when(
            value.isNotNull(), F.struct(F.lit(name).alias("name"), place.alias("place"), inside.alias("value"), share.alias("share"))
        )

    counted = (
        values.withColumn("_b", brackets)
        .select(F.explode(F.array(*[entry(name) for name in columns])).alias("e"))
        .filter("e IS NOT NULL")
        .groupBy("e.name", "e.place", "e.value", "e.share")
        .agg(F.count("*").alias("n"))
    )
    wanted = F.array_distinct(F.array(F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)))
    targets = (
        counted.groupBy("name")
        .agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("place") < 0, F.col("n")).otherwise(0)).alias("before"))
        .select("name", F.explode(wanted).alias("rank"), "before", F.lit(0).cast("long").alias("cell"))
    )

    def cell(round_: int) -> Column:
        count = float(CELLS**round_)
        return F.when(F.col("share") < 1.0, F.floor(F.col("share") * count)).when(F.col("share") == 1.0, F.lit(int(count) - 1))

    def narrowed(found: DataFrame, order: str) -> DataFrame:
        """The group that holds the wanted rank, with the rows before it."""
        upto = F.sum("n").over(Window.partitionBy("name", "rank").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return (
            found.withColumn("before", F.col("before") + upto - F.col("n"))
            .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
            .drop("n")
        )

    for round_ in range(1, ROUNDS + 2):
        one_row = targets.agg(F.collect_list(F.struct("name", "rank", "before", "cell"))).scalar()
        in_cell = F.struct("name", cell(round_ - 1).alias("cell"))
        hits = F.filter("_t", _same(in_cell))
        rows = counted.withColumn("_t", one_row).withColumn("_hit", F.explode(hits))
        last = round_ > ROUNDS
        order = F.col("value") if last else cell(round_)
        grouped = rows.groupBy("name", F.col("_hit.rank").alias("rank"), F.col("_hit.before").alias("before"), order.alias("cell"))
        targets = narrowed(grouped.agg(F.sum("n").alias("n")), "cell")

    def median(name: str) -> Column:
        value = F.when(F.col("name") == name, F.col("cell"))
        return ((F.min(value) + F.max(value)) / 2).alias(name)

    return targets.agg(*[median(name) for name in columns])


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the column median; a column without any value becomes 0."""
    medians = exact_medians(df, columns).select(F.struct(*columns).alias("m")).scalar()
    return (
        df.withColumn("_medians", medians)
        .withColumns(
            {name: F.coalesce(_usable(name), F.col("_medians")[name], F.lit(0.0)) for name in columns}
        )
        .drop("_medians")
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    moments = df.agg(
        F.struct(
            *[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd")).alias(n) for n in columns]
        ).alias("m")
    ).scalar()

    def scaled(name: str) -> Column:
        mean, sd = F.col("_moments")[name]["mean"], F.col("_moments")[name]["sd"]
        return F.when(sd > 0, (F.col(name) - mean) / sd).otherwise(F.lit(0.0))

    return (
        df.withColumn("_moments", moments)
        .withColumns({name: scaled(name) for name in columns})
        .drop("_moments")
    )


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Mean squared error and 1 - SSres / SStot in one pass.

    With a constant truth, R² is 1 for a perfect prediction and 0 otherwise.
    """
    error = F.col(truth) - F.col(prediction)
    sums = df.agg(
        F.avg(error * error).alias("mse"), F.var_pop(truth).alias("_spread"), F.count(truth).alias("_rows")
    )
    r2 = F.when(F.col("_spread") > 0, 1 - F.col("mse") / F.nullif("_spread", F.lit(0.0))).when(
        F.col("_rows") > 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select("mse", r2.alias("r2"))


def macro_auc(df: DataFrame, truth: str, class_scores: Mapping[str, str]) -> DataFrame:
    """Mean over the classes of the one-vs-rest area under the ROC curve, ties counting one half.

    Rows are first counted by (class, score). Ranks come from sums inside score ranges, cut at
    sketched quantiles, plus the totals of the lower ranges; no task sees all scores of a class.
    Null when a class has no positive or no negative row.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(column).alias("score"),
                (F.col(truth) == label).cast("long").alias("positive"),
            )
            for label, column in class_scores.items()
        ]
    )
    counts = (
        df.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.label").alias("label"), F.col("e.score").alias("score"))
        .agg(F.sum("e.positive").alias("pos"), F.sum(1 - F.col("e.positive")).alias("neg"))
    )
    shares = F.array(*[F.lit((i + 1) / (AUC_CUTS + 1)) for i in range(AUC_CUTS)])
    cuts = counts.agg(F.percentile_approx("score", shares, SKETCH_ACCURACY).alias("cuts")).scalar()
    ranged = counts.withColumn("_cuts", cuts).withColumn(
        "range", F.size(F.filter("_cuts", lambda cut: cut < F.col("score")))
    ).drop("_cuts")
    lower = Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("label", "range")
        .agg(F.sum("neg").alias("range_neg"))
        .select("label", "range", F.coalesce(F.sum("range_neg").over(lower), F.lit(0)).alias("neg_before"))
    )
    inside = (
        Window.partitionBy("label", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    )
    wins = F.col("pos") * (
        F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("neg") / 2
    )
    per_class = (
        ranged.join(totals, ["label", "range"])
        .withColumn("wins", wins)
        .groupBy("label")
        .agg(
            (F.sum("wins") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc")
        )
    )
    return per_class.agg(
        F.when(F.count("auc") == len(class_scores), F.avg("auc")).alias("macro_auc")
    )


def best_models(metrics: DataFrame) -> DataFrame:
    """The model with the highest R² and the one with the highest AUC, the first trained on ties."""

    def best(metric: str) -> Column:
        return F.max_by("model", F.struct(F.col(metric), -F.col("training_order")))

    return metrics.agg(
        best("regression_r2").alias("best_regression"),
        best("classification_auc").alias("best_classification"),
    )
