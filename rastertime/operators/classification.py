"""Supervised classification: a registry of estimators, training from points or polygons, models that can be kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.operators.classify import names_to_numbers
from rastertime.operators.polygons import reduce_regions

MODES = ("CLASSIFICATION", "REGRESSION", "PROBABILITY")
#: Classes up to which centres are kept on the driver and put into the plan.
CLASSES = 10_000


@dataclass(frozen=True)
class Kind:
    """What makes an estimator in a mode, and the names of its parameters; those of Spark by ours."""

    classifier: type
    regressor: type | None
    parameters: dict[str, str]
    given: dict[str, object] | None = None


_TREE = {"depth": "maxDepth", "bins": "maxBins", "least": "minInstancesPerNode", "seed": "seed"}
KINDS = {
    "random_forest": Kind(MC.RandomForestClassifier, MR.RandomForestRegressor, {"trees": "numTrees", "bag": "subsamplingRate", **_TREE}),
    "tree": Kind(MC.DecisionTreeClassifier, MR.DecisionTreeRegressor, _TREE),
    "boosted_trees": Kind(MC.GBTClassifier, MR.GBTRegressor, {"trees": "maxIter", "step": "stepSize", **_TREE}),
    "naive_bayes": Kind(MC.NaiveBayes, None, {"smoothing": "smoothing"}, {"modelType": "gaussian"}),
    "logistic": Kind(MC.LogisticRegression, MR.LinearRegression, {"rounds": "maxIter", "penalty": "regParam", "mix": "elasticNetParam"}),
}


def estimator(kind: str, mode: str = "CLASSIFICATION", **parameters):
    """A Spark estimator of ``label`` from ``features``; an unknown kind, mode or parameter is an error that names the known ones."""
    if kind not in KINDS:
        raise ValueError(f"no classifier {kind!r}; known: {', '.join(sorted(KINDS))}")
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; known: {', '.join(MODES)}")
    found = KINDS[kind]
    make = found.regressor if mode == "REGRESSION" else found.classifier
    if make is None:
        raise ValueError(f"{kind} has no mode {mode}")
    unknown = sorted(set(parameters) - set(found.parameters))
    if unknown:
        raise ValueError(f"{kind} has no parameters {', '.join(unknown)}; known: {', '.join(sorted(found.parameters))}")
    named = {found.parameters[k]: v for k, v in parameters.items()}
    return make(featuresCol="_features", labelCol="_label", predictionCol="classified", **({} if mode == "REGRESSION" else found.given or {}), **named)


def whole(rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows in which no feature is masked."""
    clear = F.lit(True)
    for f in features:
        clear = clear & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return rows.where(clear)


def fit(training: DataFrame, features: list[str], label: str, kind: str = "random_forest", mode: str = "CLASSIFICATION", **parameters) -> PipelineModel:
    """A fitted model of a numeric label; rows with a masked feature or label don't count. ``model.write().save(path)`` keeps it."""
    rows = whole(training, features).where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_label"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), estimator(kind, mode, **parameters)]).fit(rows)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(rows: DataFrame, model: PipelineModel, mode: str = "CLASSIFICATION") -> DataFrame:
    """Adds classified: the class number or the value; in mode PROBABILITY also probability, an array by class number.

    Rows with a masked feature have NULL there, so no cell gets lost. Columns of those names are replaced, others stay.
    """
    features = model.stages[0].getInputCols()
    kept = [c for c in rows.columns if c not in ("classified", "probability")]
    packed = rows.select(F.struct(*kept).alias("_row"), *[F.col(f).cast("double").alias(f) for f in features])
    done = model.transform(whole(packed, features))
    added = [F.col("classified")] + ([vector_to_array("probability").alias("probability")] if mode == "PROBABILITY" else [])
    done = done.select("_row", *added)
    clear = F.lit(True)
    for f in features:
        clear = clear & F.col(f).isNotNull() & ~F.isnan(F.col(f))
    none = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns[1:]]
    return done.unionByName(packed.where(~clear).select("_row", *none)).select("_row.*", *done.columns[1:])


def training_points(predictors: DataFrame, points: DataFrame, on: list[str], response: str, features: list[str]) -> tuple[DataFrame, str]:
    """The predictors at the points with their response, and the name of its number: names are numbered in their order."""
    points, number = _numbered(points.select(*on, response), response)
    return points.join(predictors.select(*on, *features), on), number


def training_polygons(predictors: DataFrame, polygons: DataFrame, keys: list[str], response: str, reducers: dict[str, Column], tile: int = 64) -> tuple[DataFrame, str]:
    """Zonal features of polygons (keys, rings, response) with their response, and the name of its number."""
    named, number = _numbered(polygons.select(*keys, response), response)
    return named.join(reduce_regions(predictors, polygons, keys, reducers, tile=tile), keys), number


def _numbered(df: DataFrame, response: str) -> tuple[DataFrame, str]:
    if dict(df.dtypes)[response] != "string":
        return df, response
    number = f"{response}_number"
    return names_to_numbers(df, response, number), number


def classified_points(predictors: DataFrame, points: DataFrame, on: list[str], response: str, features: list[str], kind: str = "random_forest", mode: str = "CLASSIFICATION", **parameters) -> tuple[PipelineModel, DataFrame]:
    """A model trained at points, and the predictors classified by it, cell by cell."""
    training, number = training_points(predictors, points, on, response, features)
    model = fit(training, features, number, kind, mode, **parameters)
    return model, classify(predictors, model, mode)


def classified_polygons(predictors: DataFrame, reference: DataFrame, apply: DataFrame, keys: list[str], response: str, reducers: dict[str, Column], kind: str = "random_forest", mode: str = "CLASSIFICATION", tile: int = 64, **parameters) -> tuple[PipelineModel, DataFrame]:
    """A model trained on the zonal features of reference polygons, and other polygons classified by it; any number of them."""
    training, number = training_polygons(predictors, reference, keys, response, reducers, tile)
    model = fit(training, list(reducers), number, kind, mode, **parameters)
    return model, classify(reduce_regions(predictors, apply, keys, reducers, tile=tile), model, mode)


def centres(training: DataFrame, features: list[str], label: str) -> list[tuple]:
    """(label, means of the features) of every class, by label; sums are partial before the shuffle."""
    rows = whole(training, features).where(F.col(label).isNotNull())
    found = rows.groupBy(label).agg(*[F.avg(f).alias(f) for f in features]).orderBy(label).limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    return [tuple(r) for r in found]


def nearest_centre(rows: DataFrame, found: list[tuple], features: list[str]) -> DataFrame:
    """Adds classified: the label of the nearest centre, of equally near ones (to nine digits) the least; NULL for masked features."""
    if not found:
        return rows.withColumn("classified", F.lit(None).cast("double"))
    distance = lambda c: sum(((F.col(f) - dbl(x)) * (F.col(f) - dbl(x)) for f, x in zip(features, c[1:])), dbl(0))
    best = F.array_min(F.array(*[F.struct(F.round(distance(c), 9).alias("far"), F.lit(c[0]).alias("label")) for c in found]))
    clear = F.lit(True)
    for f in features:
        clear = clear & F.col(f).isNotNull()
    return rows.withColumn("classified", F.when(clear, best["label"]))
