"""Risk models: target, split, training, evaluation and scoring with MLlib."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from roadrisk.config import ML_FEATURES, MODEL_RULES, ModelRules
from roadrisk.functions.scores import clamp, service_category, training_category
from roadrisk.operators.stats import impute_medians, macro_auc, regression_metrics
from roadrisk.sources.scratch import cut_lineage

log = logging.getLogger(__name__)

CLASSES = ("high", "low", "medium")  # in the order of their names
FAMILIES = ("random_forest", "logistic_regression", "gradient_boosting")


def synthetic_score(columns: Sequence[str], noise: Column | float = 0.0) -> Column:
    """Rule score from the features that are present, before clamping: at least 0.5 without noise."""

    def term(name: str, value: Column, cap: float) -> Column:
        return F.least(value, F.lit(cap)) if name in columns else F.lit(0.0)

    return (
        F.lit(0.5)
        + term("harsh_braking_count", F.col("harsh_braking_count") / 50.0, 0.2)
        + term("harsh_acceleration_count", F.col("harsh_acceleration_count") / 50.0, 0.2)
        + term("over_speed_ratio", F.col("over_speed_ratio"), 0.2)
        + term("phone_usage_ratio", F.col("phone_usage_ratio"), 0.1)
        + term("night_driving_ratio", F.col("night_driving_ratio") * 0.1, 0.1)
        + noise
    )


def driver_noise(sd: float, seed: int) -> Column:
    """Normal noise that depends on the driver only, so that a recomputed task repeats it.

    Two uniform numbers from a hash of the driver go through the Box-Muller formula.
    """

    def uniform(salt: str) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("driver_id")))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0

    return F.sqrt(-2.0 * F.log(uniform("a"))) * F.cos(2.0 * F.pi() * uniform("b")) * sd


def with_synthetic_target(
    features: DataFrame, noise_sd: float = MODEL_RULES.noise_sd, seed: int = MODEL_RULES.seed
) -> DataFrame:
    noise = driver_noise(noise_sd, seed) if noise_sd else F.lit(0.0)
    return features.withColumn("risk_score", clamp(synthetic_score(features.columns, noise), 0.0, 1.0))


def with_split(df: DataFrame, test_share: int = MODEL_RULES.test_share) -> DataFrame:
    """One driver in ``test_share`` goes to the test set, by hash: the same for every target."""
    bucket = F.conv(F.substring(F.md5("driver_id"), 1, 8), 16, 10).cast("bigint") % test_share
    return df.withColumn("split", F.when(bucket == 0, "test").otherwise("train"))


def numeric_features(df: DataFrame, target: str | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in ("driver_id", target)
    ]


def prepare_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Driver, target and the numeric columns as doubles without nulls."""
    names = numeric_features(df, target)
    if not names:
        raise ValueError("No numeric features found for training!")
    kept = [target] if target else []
    return df.select(
        "driver_id", *kept, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    )


def align_features(df: DataFrame, names: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The training columns in training order: extra ones go, missing ones and nulls become 0."""
    return df.select(
        "driver_id",
        *carried,
        *[
            F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)
            if n in df.columns
            else F.lit(0.0).alias(n)
            for n in names
        ],
    )


@dataclass
class RiskModel:
    """One trained family: scaler, regressor and classifiers (one, or one per class)."""

    name: str
    features: list[str]
    preparation: PipelineModel
    regressor: object
    classifiers: dict[str, object]
    labels: list[str]
    train_rows: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``risk_score``, ``category`` and one probability per class; other columns ride along in a struct, so
        that a driver may have several rows."""
        columns = ["driver_id", "risk_score", "category", *[f"p_{label}" for label in self.labels]]
        extra = [c for c in df.columns if c not in self.features and c not in columns]
        carried = ()
        if extra:
            df, carried = df.withColumn("_carried", F.struct(*extra)), ("_carried",)
        scaled = self.preparation.transform(align_features(df, self.features, carried))
        scored = self.regressor.transform(scaled).withColumn("risk_score", clamp(F.col("prediction"), 0.0, 1.0))
        scored = scored.drop("prediction", *[n for n in self.features])
        for label, model in self.classifiers.items():
            scored = (
                model.transform(scored)
                .withColumn(f"_p_{label}", vector_to_array("probability"))
                .drop("prediction", "rawPrediction", "probability")
            )
        if "all" in self.classifiers:
            chances = {label: F.col("_p_all")[k] for k, label in enumerate(self.labels)}
        else:
            raw = {label: F.col(f"_p_{label}")[1] for label in self.labels}
            total = sum(raw.values(), F.lit(0.0))
            chances = {label: chance / total for label, chance in raw.items()}
        scored = scored.withColumns({f"p_{label}": chance for label, chance in chances.items()})
        best = F.array_max(
            F.array(
                *[
                    F.struct(F.col(f"p_{label}").alias("p"), F.lit(-k).alias("k"), F.lit(label).alias("label"))
                    for k, label in enumerate(self.labels)
                ]
            )
        )
        result = scored.withColumn("category", best["label"])
        return result.select(*columns, *[F.col("_carried")[c].alias(c) for c in extra])


@dataclass
class TrainedModels:
    """Trained families in training order with their metrics."""

    features: list[str]
    models: dict[str, RiskModel] = field(default_factory=dict)
    metrics: dict[str, dict[str, float | None]] = field(default_factory=dict)
    importance: dict[str, dict[str, float]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def parts(self) -> tuple[dict, ...]:
        return self.models, self.metrics, self.importance, self.failures

    def choose(self, name: str) -> RiskModel:
        """The named family, else the first trained one."""
        if not self.models:
            raise ValueError("Models must be trained before prediction")
        return self.models.get(name) or next(iter(self.models.values()))

    def whole(self, families: Sequence[str], part: str = "models") -> TrainedModels:
        """Itself if ``part`` has all of the families, else an error with their failures: a shorter result looks whole."""
        missing = [name for name in families if name not in getattr(self, part)]
        if missing:
            reasons = "; ".join(f"{name}: {self.failures.get(name, 'not trained')}" for name in missing)
            raise ValueError(f"Training failed for {reasons}")
        return self


def _preparation(train: DataFrame, names: Sequence[str]) -> PipelineModel:
    """Assembled, centred vectors of unit sample deviation.

    The population deviation differs by a factor common to all features, which matters to the
    penalized logistic models only; ``fit_family`` corrects their penalty for it.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(names), outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True),
        ]
    ).fit(train)


def _side_by_side(fits: Mapping[str, Callable[[], object]]) -> dict[str, object]:
    """Results of independent fits, which wait for many small jobs rather than for cores."""
    with ThreadPool(max(1, len(fits))) as pool:
        return dict(zip(fits, pool.map(lambda fit: fit(), fits.values())))


def _fit_binary(make, train: DataFrame, label: str) -> object:
    """The classifier of one class against the others."""
    return make().fit(train.withColumn("_is", (F.col("category") == label).cast("double")))


def fit_family(
    name: str, train: DataFrame, names: Sequence[str], rules: ModelRules = MODEL_RULES
) -> RiskModel:
    """Train one family on prepared rows with ``risk_score`` and ``category``."""
    preparation = _preparation(train, names)
    rows = preparation.transform(train).select("driver_id", "risk_score", "category", "scaled")
    counts = {r["category"]: r["count"] for r in rows.groupBy("category").count().collect()}
    labels = [label for label in CLASSES if label in counts]
    n = sum(counts.values())
    common = {"featuresCol": "scaled"}
    if name == "random_forest":
        indexer = StringIndexer(inputCol="category", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
        forest = {"numTrees": rules.trees, "maxDepth": rules.forest_depth, "seed": rules.seed, **common}
        regressor = RandomForestRegressor(labelCol="risk_score", **forest)
        fits = {"all": lambda: RandomForestClassifier(labelCol="_label", **forest).fit(indexer.transform(rows))}
    elif name == "logistic_regression":
        regressor = LinearRegression(labelCol="risk_score", **common)

        def classifier():
            return LogisticRegression(
                labelCol="_is",
                # (n - 1) / n: the penalty as if features had unit population deviation
                regParam=(n - 1) / n / (n * rules.inverse_penalty),
                maxIter=rules.max_iterations,
                standardization=False,
                **common,
            )

        fits = {label: partial(_fit_binary, classifier, rows, label) for label in labels}
    elif name == "gradient_boosting":
        boost = {
            "maxIter": rules.rounds,
            "maxDepth": rules.boosting_depth,
            "stepSize": rules.learning_rate,
            "seed": rules.seed,
            **common,
        }
        regressor = GBTRegressor(labelCol="risk_score", **boost)
        fits = {label: partial(_fit_binary, lambda: GBTClassifier(labelCol="_is", **boost), rows, label) for label in labels}
    else:
        raise ValueError(f"unknown model family {name}")
    classifiers = _side_by_side({"": lambda: regressor.fit(rows), **fits})
    return RiskModel(name, list(names), preparation, classifiers.pop(""), classifiers, labels, n)


def importance_of(model: RiskModel) -> dict[str, float]:
    """Weight of each feature: of the forest or boosting regressor, else the absolute logistic
    coefficients of the first class."""
    if hasattr(model.regressor, "featureImportances"):
        values = model.regressor.featureImportances.toArray()
    else:
        to_population_scale = ((model.train_rows - 1) / model.train_rows) ** 0.5
        values = abs(model.classifiers[model.labels[0]].coefficients.toArray()) * to_population_scale
    return dict(zip(model.features, (float(v) for v in values)))


def regressor_importance(model: RiskModel) -> dict[str, float]:
    """As ``importance_of``, but empty where the regressor itself has no importances."""
    return importance_of(model) if hasattr(model.regressor, "featureImportances") else {}


def evaluate(model: RiskModel, test: DataFrame) -> dict[str, float | None]:
    """Error, R² and macro AUC on held-out rows; no AUC where a class is missing there."""
    scored = cut_lineage(model.transform(test.withColumnsRenamed({"risk_score": "truth", "category": "truth_label"})))
    errors = regression_metrics(scored, "truth", "risk_score").first()
    auc = macro_auc(scored, "truth_label", {label: f"p_{label}" for label in model.labels}).first()
    return {
        "regression_mse": errors["mse"],
        "regression_r2": errors["r2"],
        "classification_auc": auc["macro_auc"],
    }


def train_models(
    features: DataFrame,
    target: str | None = None,
    families: Sequence[str] = FAMILIES,
    rules: ModelRules = MODEL_RULES,
) -> TrainedModels:
    """Train every family; a failing one is recorded and skipped, too few rows train nothing and fail all of them.

    A caller that shows the result as that of all families asks for it with ``TrainedModels.whole``.
    The driver-side loop runs over families only, which train side by side. Prepared rows are written once as a checkpoint,
    so iterations do not recompute the features and survive lost executors.
    """
    names = [n for n in numeric_features(features, target) if n != "risk_score"]
    imputed = impute_medians(features, names)
    if target is None or target not in features.columns:
        imputed, target = with_synthetic_target(imputed, rules.noise_sd, rules.seed), "risk_score"
    prepared = prepare_features(imputed, target).withColumnRenamed(target, "risk_score")
    rows = cut_lineage(
        with_split(prepared, rules.test_share).withColumn("category", training_category(F.col("risk_score")))
    )
    result = TrainedModels(list(names))
    if rows.limit(rules.min_rows).count() < rules.min_rows:
        result.failures.update((name, f"fewer than {rules.min_rows} rows") for name in families)
        return result
    train = rows.filter("split = 'train'").drop("split")
    test = rows.filter("split = 'test'").drop("split")

    def one(name: str) -> tuple:
        model = weights = metrics = failure = None
        try:
            model = fit_family(name, train, names, rules)
            weights = importance_of(model)
            metrics = evaluate(model, test)
        except Exception as error:  # noqa: BLE001
            log.warning("training %s failed: %s", name, error)
            failure = str(error) or repr(error)
        return model, weights, metrics, failure

    for name, (model, weights, metrics, failure) in _side_by_side({name: partial(one, name) for name in families}).items():
        if model is not None:
            result.models[name] = model  # usable even if its evaluation fails
        if weights is not None:
            result.importance[name] = weights
        if metrics is not None:
            result.metrics[name] = metrics
        if failure is not None:
            result.failures[name] = failure
    return result


def predict_scores(trained: TrainedModels, features: DataFrame, name: str = "random_forest") -> DataFrame:
    return trained.choose(name).transform(features.select(_known(features))).select("driver_id", "risk_score")


def predict_categories(
    trained: TrainedModels, features: DataFrame, name: str = "random_forest"
) -> DataFrame:
    model = trained.choose(name)
    return model.transform(features.select(_known(features))).drop("risk_score")


def _known(features: DataFrame) -> list[str]:
    return ["driver_id", *[n for n in features.columns if n in ML_FEATURES]]


def batch_score(trained: TrainedModels, features: DataFrame, name: str = "random_forest") -> DataFrame:
    """Score, service category and number of drivers of each category."""
    return predict_scores(trained, features, name).withColumn(
        "risk_category", service_category(F.col("risk_score"))
    )


def metrics_table(trained: TrainedModels, spark) -> DataFrame:
    """One row per evaluated family, in training order."""
    rows = [
        (name, k, *trained.metrics[name].values()) for k, name in enumerate(trained.models) if name in trained.metrics
    ]
    schema = "model string, training_order int, regression_mse double, regression_r2 double, classification_auc double"
    return spark.createDataFrame(rows, schema)


def importance_table(trained: TrainedModels, spark) -> DataFrame:
    rows = [
        (name, feature, value) for name, values in trained.importance.items() for feature, value in values.items()
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")
