"""Features and baseline models for a binary target with Spark ML, their evaluation, and packages for later scoring."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from itertools import accumulate
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.identity import number_rows
from ..functions.predicates import family
from ..storage import materialize
from . import curves
from .prepare import mode_value
from .quantiles import quantiles

#: Levels of a text column beyond which it is refused: the levels of all text columns are held by the driver and by the model.
MOST_LEVELS = 10_000
MODELS = ("logistic_regression", "random_forest")
_N, _C, _I, _H = "_tp_num", "_tp_cat", "_tp_idx", "_tp_hot"
#: Columns of models that rows are given while they are scored.
_COLUMNS = {"featuresCol": "_tp_features", "rawPredictionCol": "_tp_raw", "probabilityCol": "_tp_prob", "predictionCol": "_tp_pred"}


@dataclass
class Learned:
    """What training rows say about their columns: fill values, means and spreads of numbers; fill values of texts."""

    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def feature_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric columns, and all others (booleans and dates too), which count as texts."""
    numeric = [c for c in features if family(df.schema[c].dataType) == "numeric"]
    return numeric, [c for c in features if c not in numeric]


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _number(c: str) -> str:
    """A numeric cell as double; NaN counts as missing."""
    return f"nullif(CAST({_quoted(c)} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def learn(train: DataFrame, features: list[str], most_levels: int | None = None) -> Learned:
    """Learns from training rows only. Columns without any value are left out; without any other column it refuses. most_levels: of a text column (MOST_LEVELS); 0 for any number."""
    most_levels = MOST_LEVELS if most_levels is None else most_levels
    numeric, texts = feature_kinds(train, features)
    got = Learned()
    numbers = train.selectExpr(*(f"{_number(c)} AS {_quoted(c)}" for c in numeric)) if numeric else None
    got.medians = {c: v for c, (v,) in quantiles(numbers, numeric, [0.5]).items() if v is not None} if numeric else {}
    if got.medians:
        filled = {c: F.coalesce(F.col(_quoted(c)), F.lit(v)) for c, v in got.medians.items()}
        facts = numbers.agg(*(f(x).alias(f"{k}{i}") for i, x in enumerate(filled.values()) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for i, c in enumerate(got.medians):
            got.means[c], got.scales[c] = facts[f"m{i}"], facts[f"s{i}"] or 1.0
    for c in texts:
        # exact, and no more than one level beyond the limit is looked for
        if most_levels and train.where(F.col(_quoted(c)).isNotNull()).select(_quoted(c)).distinct().limit(most_levels + 1).count() > most_levels:
            raise Refused("too_many_levels", c)
        value = mode_value(train.select(F.col(_quoted(c)).cast("string").alias(c)), c)
        if value is not None:
            got.modes[c] = value
    if not got.medians and not got.modes:
        raise Refused("no_usable_features")
    return got


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_stages(got: Learned, scaled: bool) -> list:
    """Stages of a Spark ML pipeline that make the column features: filled (and scaled) numbers, and one position per level.

    Levels that training rows lack give zeros only.
    """
    made = []
    for i, (c, v) in enumerate(got.medians.items()):
        x = f"coalesce({_number(c)}, CAST('{v!r}' AS DOUBLE))"
        made.append(f"({x} - CAST('{got.means[c]!r}' AS DOUBLE)) / CAST('{got.scales[c]!r}' AS DOUBLE) AS {_N}{i}" if scaled else f"{x} AS {_N}{i}")
    made += [f"coalesce(CAST({_quoted(c)} AS STRING), {_literal(v)}) AS {_C}{i}" for i, (c, v) in enumerate(got.modes.items())]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")]
    names = lambda kind: [f"{kind}{i}" for i in range(len(got.modes))]
    if got.modes:
        stages.append(StringIndexer(inputCols=names(_C), outputCols=names(_I), handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=names(_I), outputCols=names(_H), handleInvalid="error", dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"{_N}{i}" for i in range(len(got.medians))] + names(_H), outputCol="_tp_features"))
    return stages


def preprocess(train: DataFrame, df: DataFrame, features: list[str], scaled: bool = True) -> DataFrame:
    """df with the column features, as learned from train."""
    made = Pipeline(stages=feature_stages(learn(train, features), scaled)).fit(train).transform(df)
    return made.select(*(_quoted(c) for c in df.columns), F.col("_tp_features").alias("features"))


def level_numbers(train: DataFrame, got: Learned) -> dict[str, DataFrame]:
    """Per text column its levels in order, (level, n): numbered by ranges, however many there are; the driver holds none."""
    return {c: number_rows(train.select(F.coalesce(F.col(_quoted(c)).cast("string"), F.lit(v)).alias("level")).distinct(), ["level"], column="n") for c, v in got.modes.items()}


def preprocess_sparse(train: DataFrame, df: DataFrame, features: list[str], scaled: bool = True) -> DataFrame:
    """df with the features as size, indices and values (those that aren't 0, in order of their places), for text columns of any number of levels.

    The same places as of preprocess: numbers first, then a place for each level of each text column. Rows join the numbered levels; a level that training rows
    lack has no place. Every level of a numeric feature's value 0 stays out.
    """
    got = learn(train, features, most_levels=0)
    own = [F.col(_quoted(c)) for c in df.columns]
    size, places = len(got.medians), []
    for i, (c, v) in enumerate(got.medians.items()):
        x = F.coalesce(F.expr(_number(c)), F.lit(v))
        places.append(F.struct(F.lit(i).cast("long").alias("i"), ((x - F.lit(got.means[c])) / F.lit(got.scales[c]) if scaled else x).alias("v")))
    joined, kept = df, [f"_tp_level{i}" for i in range(len(got.modes))]
    for at, (c, levels) in zip(kept, level_numbers(train, got).items(), strict=True):
        found = levels.select(F.col("level").alias("_tp_text"), (F.col("n") + F.lit(size)).alias(at))
        joined = joined.join(found, F.coalesce(F.col(_quoted(c)).cast("string"), F.lit(got.modes[c])) == F.col("_tp_text"), "left").drop("_tp_text")
        places.append(F.struct(F.col(at).alias("i"), F.lit(1.0).alias("v")))
        size += levels.count()
    held = F.filter(F.array(*places), lambda x: x["i"].isNotNull() & (x["v"] != 0))
    made = joined.withColumn("_tp_held", held)
    return made.select(*own, F.lit(size).cast("long").alias("size"), F.col("_tp_held.i").alias("indices"), F.col("_tp_held.v").alias("values"))


def drawn(seed: int, bag: Column, row: Column) -> Column:
    """How often a bag holds a row: a Poisson draw of mean 1, inverted at a hash of seed, bag and row."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), bag, row), 11) / F.lit(2.0**53)
    out = F.lit(19)
    for k, c in reversed(list(enumerate(accumulate(math.exp(-1) / math.factorial(i) for i in range(19))))):
        out = F.when(u < F.lit(c), k).otherwise(out)
    return out


def bag_weights(rows: DataFrame, label: str, row: str, bags: int, seed: int) -> DataFrame:
    """bag, label, n (draws of the class), weight: all draws of the bag over the classes in it and the draws of this class. One pass; bags without any draw are left out."""
    each = rows.select(label, row, F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    counts = each.groupBy("bag", label).agg(F.sum(drawn(seed, F.col("bag"), F.col(row))).alias("n")).where("n > 0")
    per_bag = counts.groupBy("bag").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("classes"))
    return counts.join(per_bag, "bag").select("bag", label, "n", (F.col("all_n") / (F.col("classes") * F.col("n"))).alias("weight"))


def bagged_forest(rows: DataFrame, trees: int, seed: int, parallel: int = 8) -> RandomForestClassificationModel:
    """A forest whose trees each weight the classes of their own bag alike; probabilities are averaged over the trees.

    rows: _tp_features, _tp_label (0 or 1) and _tp_row, different for each row. The weights of all bags are counted in one pass. A tree is then fitted over its bag's
    rows by Spark, ``parallel`` trees at a time, as it can't weight the trees of one fit apart. Small bags may lack a class, and are then all of the other.
    """
    weights: dict[int, dict[float, float]] = {}
    for r in bag_weights(rows, "_tp_label", "_tp_row", trees, seed).collect():  # two rows for each tree at the most
        weights.setdefault(r["bag"], {})[r["_tp_label"]] = r["weight"]
    settings = {"maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": seed, "labelCol": "_tp_label", "weightCol": "_tp_weight", **_COLUMNS}
    label = F.col("_tp_label").alias("_tp_label", metadata={"ml_attr": {"type": "nominal", "name": "_tp_label", "vals": ["0", "1"]}})

    def fit(bag: int) -> RandomForestClassificationModel:
        own = weights[bag]
        weight = F.col("_tp_n") * F.when(F.col("_tp_label") == 1.0, own.get(1.0, 0.0)).otherwise(own.get(0.0, 0.0))
        held = rows.withColumn("_tp_n", drawn(seed, F.lit(bag), F.col("_tp_row"))).where("_tp_n > 0").select("_tp_features", label, weight.alias("_tp_weight"))
        return RandomForestClassifier(numTrees=1, bootstrap=False, **settings).setSeed(seed + bag).fit(held)

    with ThreadPool(parallel) as pool:
        fitted = pool.map(fit, sorted(weights), chunksize=1)
    context = rows.sparkSession.sparkContext
    held = context._gateway.new_array(context._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(fitted))
    for i, model in enumerate(fitted):
        held[i] = model._java_obj.trees()[0]
    made = context._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(fitted[0].uid, held, fitted[0].numFeatures, 2)
    out = RandomForestClassificationModel(made)
    # written models tell their settings, and are refused with another number of trees
    return out._set(**{k: v for k, v in settings.items() if out.hasParam(k)} | {"numTrees": len(fitted)})


def train_models(train: DataFrame, target: str, features: list[str], positive: object = None, models: tuple[str, ...] = MODELS, seed: int = 42) -> dict[str, PipelineModel]:
    """Fits each model on the training rows, both classes weighted alike: over all rows, or for each tree of the forest over its bag. The positive class is the largest value unless given."""
    counts = {r[0]: r[1] for r in train.groupBy(target).count().limit(3).collect()}
    if None in counts or len(counts) != 2:
        raise Refused("target_missing" if None in counts else "target_not_binary")
    positive = max(counts) if positive is None else positive
    n = sum(counts.values())
    weight = F.when(F.col(target) == F.lit(positive), n / (2.0 * counts[positive])).otherwise(n / (2.0 * (n - counts[positive])))
    # rows are numbered as they are written, so that bags hold the same ones whenever they are read
    rows = materialize(train.withColumns({"_tp_label": (F.col(target) == F.lit(positive)).cast("double"), "_tp_weight": weight, "_tp_row": F.monotonically_increasing_id()}))
    got = learn(rows, features)
    out = {}
    for name in models:
        if name == "logistic_regression":
            last = LogisticRegression(maxIter=500, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, labelCol="_tp_label", weightCol="_tp_weight", **_COLUMNS)
            out[name] = Pipeline(stages=[*feature_stages(got, True), last]).fit(rows)
        elif name == "random_forest":
            made = Pipeline(stages=feature_stages(got, False)).fit(rows)
            forest = bagged_forest(materialize(made.transform(rows).select("_tp_features", "_tp_label", "_tp_row")), 100, seed)
            out[name] = PipelineModel([*made.stages, forest])
        else:
            raise Refused("unknown_model", name)
    return out


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with score, the probability of the positive class, and predicted, whether it reaches the threshold."""
    made = model.transform(df).withColumn("_tp_score", vector_to_array("_tp_prob")[1])
    return made.select(*(_quoted(c) for c in df.columns), F.col("_tp_score").alias("score"), (F.col("_tp_score") >= threshold).alias("predicted"))


def long_scores(models: dict[str, PipelineModel], df: DataFrame, target: str, positive: object) -> DataFrame:
    """(model, truth, score) of all models, written once: every metric reads it."""
    out = None
    for name, model in models.items():
        part = score(model, df.select(F.col(f"{_quoted(target)}").eqNullSafe(F.lit(positive)).cast("int").alias("_tp_truth"), *(_quoted(c) for c in df.columns)))
        part = part.select(F.lit(name).alias("model"), F.col("_tp_truth").alias("truth"), "score")
        out = part if out is None else out.unionByName(part)
    return materialize(out)


def validation_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per model: the four counts, precision, recall, f1, accuracy, roc_auc, pr_auc."""
    return curves.prf_metrics(scores, threshold).join(curves.roc_auc(scores), "model").join(curves.average_precision(scores), "model")


def model_comparison(scores: DataFrame) -> DataFrame:
    """Per model its metrics at 0.5, best pr_auc first."""
    return validation_metrics(scores).orderBy(F.desc("pr_auc"), "model").select("model", "pr_auc", "roc_auc", "precision", "recall", "f1", "fp", "fn")


def final_test(scores: DataFrame, model: str, threshold: float) -> DataFrame:
    """All metrics of exactly this model at exactly this threshold, over the test rows."""
    if not 0 <= threshold <= 1:
        raise Refused("invalid_threshold", str(threshold))
    own = scores.where(F.col("model") == model)
    if own.isEmpty():
        raise Refused("unknown_model", model)
    return validation_metrics(own, threshold).withColumns({"threshold": F.lit(float(threshold)), "test_rows": F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")})


def metrics_export(validation: DataFrame, test: DataFrame, model: str, threshold: float, least_recall: float) -> DataFrame:
    """The metrics of three stages in one table: validation at 0.5, validation at the chosen thresholds, final test."""
    stages = [
        ("validation_default_0.5", model_comparison(validation)),
        ("validation_selected_threshold", curves.optimize_threshold(validation, least_recall)),
        ("final_test_locked_threshold", final_test(test, model, threshold)),
    ]
    out = None
    for name, rows in stages:
        rows = rows.select(F.lit(name).alias("stage"), "*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.option("header", True).csv(path)


def save_package(model: PipelineModel, path: str, name: str, threshold: float, target: str, positive: object, features: list[str]) -> None:
    """Writes the fitted pipeline and what its use needs below path; no rows of the data."""
    model.write().save(f"{path}/model")
    about = {"format_version": 1, "model_name": name, "selected_threshold": float(threshold), "target_column": target, "positive_class": positive, "feature_columns": features, "rule": "positive when score >= selected_threshold"}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load_package(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first()[0])


def score_batch(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """df with score and predicted, by the package's model and threshold."""
    model, about = load_package(spark, path)
    if missing := [c for c in about["feature_columns"] if c not in df.columns]:
        raise Refused("unknown_column", ", ".join(missing))
    return score(model, df, about["selected_threshold"])
