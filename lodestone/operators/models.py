"""Models of tables: trained, evaluated, applied, inspected and stored by name, on Spark's own distributed learners.

Inputs are numbers, texts (one-hot, at most 32,000 values) and arrays of numbers; rows with a null input or label are
left out of training and predicted as null. Every result that is a table comes as a DataFrame.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, metrics

REGRESSORS = {"LINEAR_REG": LinearRegression, "RANDOM_FOREST_REGRESSOR": RandomForestRegressor, "BOOSTED_TREE_REGRESSOR": GBTRegressor}
CLASSIFIERS = {"LOGISTIC_REG": LogisticRegression, "RANDOM_FOREST_CLASSIFIER": RandomForestClassifier, "BOOSTED_TREE_CLASSIFIER": GBTClassifier}
#: Options of the surface as parameters of the learners.
OPTIONS = {
    "l2_reg": "regParam", "l1_reg_share": "elasticNetParam", "max_iterations": "maxIter", "num_trees": "numTrees", "max_tree_depth": "maxDepth", "num_clusters": "k", "num_principal_components": "k",
    "num_factors": "rank", "seed": "seed", "subsample": "subsamplingRate", "learn_rate": "stepSize", "tolerance": "tol",
}
#: Classes of an input's values that trees choose thresholds from: an input of up to so many different values has a
#: threshold between any two of them, as far as the learner's sample of BINS^2 rows has them.
BINS = 256
#: Centres times inputs for which all distances of a row fit generated code.
UNROLLED = 512


@dataclass
class Model:
    kind: str
    inputs: list[str]
    label: str | None
    stages: PipelineModel | None
    labels: list = field(default_factory=list)
    statistics: dict[str, tuple[float, float]] = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    seconds: float = 0.0
    #: Sum of the squared distances from the centres, where the learner's own summary does not have it.
    cost: float | None = None

    @property
    def learner(self):
        return self.stages.stages[-1]


def _features(df: DataFrame, inputs: Sequence[str]) -> tuple[list, list[str], DataFrame]:
    """(stages, names of the assembled columns, rows) for inputs of any kind."""
    kinds, stages, columns = dict(df.dtypes), [], []
    for name in inputs:
        if kinds[name] == "string":
            stages += [StringIndexer(inputCol=name, outputCol=f"{name}__index", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{name}__index"], outputCols=[f"{name}__hot"], handleInvalid="keep")]
            columns.append(f"{name}__hot")
        elif kinds[name].startswith("array"):
            df = df.withColumn(f"{name}__vector", array_to_vector(F.col(name).cast("array<double>")))
            columns.append(f"{name}__vector")
        else:
            df = df.withColumn(f"{name}__number", F.col(name).cast("double"))
            columns.append(f"{name}__number")
    return [*stages, VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="keep")], columns, df


def _weighted(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Equal rows of inputs as one, with their number as __weight; learners that sum over rows find the same."""
    return df.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("__weight"))


def _plain(df: DataFrame, inputs: Sequence[str]) -> bool:
    """Whether all inputs are numbers."""
    kinds = dict(df.dtypes)
    return all(kinds[n] != "string" and not kinds[n].startswith("array") for n in inputs)


def _numbers(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Inputs that are numbers, of the rows that have them all."""
    return df.dropna(subset=list(inputs)).select(*(F.col(f"`{n}`").cast("double").alias(f"{n}__number") for n in inputs))


class Models:
    """The models of a session, by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[str, Model] = {}

    def create(self, name: str, kind: str, rows: DataFrame, label: str | None = None, or_replace: bool = False, if_not_exists: bool = False, **options) -> Model:
        """CREATE MODEL; kind: a model type of the surface."""
        if name in self.known and not or_replace:
            if if_not_exists:
                return self.known[name]
            raise ValueError(f"model {name} exists")
        began, given = time.time(), {OPTIONS[k]: v for k, v in options.items() if k in OPTIONS}
        if unknown := options.keys() - OPTIONS.keys() - {"user", "item", "rating", "inputs"}:
            raise ValueError(f"there are no options {', '.join(sorted(unknown))}")
        if "FOREST" in kind or "BOOSTED" in kind:
            given["maxBins"] = BINS
        if kind == "MATRIX_FACTORIZATION":
            user, item, rating = options["user"], options["item"], options["rating"]
            als = ALS(userCol=user, itemCol=item, ratingCol=rating, coldStartStrategy="nan", nonnegative=False, **({"seed": 1} | given))
            made = Model(kind, [user, item], rating, Pipeline(stages=[als]).fit(rows.dropna(subset=[user, item, rating])))
        else:
            inputs = list(options.get("inputs") or [c for c in rows.columns if c != label])
            whole = rows.dropna(subset=[*inputs, *([label] if label else [])])
            stages, _, whole = _features(whole, inputs)
            made = Model(kind, inputs, label, None)
            if kind in CLASSIFIERS:
                index = StringIndexer(inputCol=f"{label}__text", outputCol="__label", stringOrderType="alphabetAsc").fit(whole.withColumn(f"{label}__text", F.col(label).cast("string")))
                whole = index.transform(whole.withColumn(f"{label}__text", F.col(label).cast("string")))
                made.labels = index.labels
                stages += [CLASSIFIERS[kind](featuresCol="__features", labelCol="__label", **given)]
            elif kind in REGRESSORS:
                whole = whole.withColumn("__label", F.col(label).cast("double"))
                stages += [REGRESSORS[kind](featuresCol="__features", labelCol="__label", **given)]
            elif kind == "KMEANS":
                stages += [KMeans(featuresCol="__features", weightCol="__weight", **({"seed": 1} | given))]
            elif kind == "PCA":
                stages += [PCA(inputCol="__features", outputCol="__components", **given)]
            elif kind != "TRANSFORM_ONLY":
                raise ValueError(f"there is no model type {kind}")
            fitted = whole
            many, grouped = clusters.repeats(_numbers(whole, inputs)) if kind == "KMEANS" and _plain(whole, inputs) else (False, False)
            if many:
                # passes over all rows find the centres; the learner only takes them over, as they are
                learner = stages[-1]
                centres, made.cost = clusters.centres_of(_numbers(whole, inputs), learner.getK(), learner.getMaxIter(), learner.getTol(), learner.getSeed(), grouped)
                stages[-1] = learner.copy({learner.k: len(centres), learner.initMode: "random", learner.maxIter: 0, learner.solver: "row"})
                each = [F.struct(*(F.lit(float(x)).alias(f"{n}__number") for n, x in zip(inputs, v)), F.lit(1.0).alias("__weight")) for v in centres]
                fitted = self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*each)))
            elif kind == "KMEANS":
                # the index of texts goes by their frequency in rows
                fitted = _features(_weighted(whole, inputs), inputs)[2] if _plain(whole, inputs) else whole.withColumn("__weight", F.lit(1.0))
            made.stages = Pipeline(stages=stages).fit(fitted)
            numbers = [c for c, t in rows.dtypes if c in inputs and t not in ("string",) and not t.startswith("array")]
            if numbers:
                row = whole.agg(*(F.avg(c).alias(f"a_{c}") for c in numbers), *(F.stddev_samp(c).alias(f"s_{c}") for c in numbers)).first()
                made.statistics = {c: (row[f"a_{c}"], row[f"s_{c}"]) for c in numbers}
        made.seconds = time.time() - began
        self.known[name] = made
        return made

    def _model(self, name: str, *kinds: str) -> Model:
        if name not in self.known:
            raise KeyError(f"there is no model {name}")
        if kinds and self.known[name].kind not in kinds:
            raise ValueError(f"{name} is a {self.known[name].kind} model")
        return self.known[name]

    def alter(self, name: str, **options) -> None:
        self._model(name).options |= options

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.known.pop(name, None) is None and not if_exists:
            raise KeyError(f"there is no model {name}")

    def export(self, name: str, path: str) -> None:
        self._model(name).stages.write().overwrite().save(path)

    def load(self, name: str, path: str, like: str) -> None:
        """A model exported before; like: one with its inputs and labels."""
        old = self._model(like)
        self.known[name] = Model(old.kind, old.inputs, old.label, PipelineModel.load(path), old.labels, old.statistics, cost=old.cost)

    def _applied(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name)
        return model.stages.transform(_features(rows, model.inputs)[2] if model.kind != "MATRIX_FACTORIZATION" else rows)

    def predict(self, name: str, rows: DataFrame, threshold: float | None = None) -> DataFrame:
        """rows with predicted_<label>, of classifiers the labels' probabilities too, of clusters and components theirs."""
        model, made = self._model(name), self._applied(name, rows)
        if model.kind in CLASSIFIERS:
            p = vector_to_array("probability")
            labels = F.array(*map(F.lit, model.labels))
            best = F.when(p[1] >= threshold, F.lit(model.labels[1])).otherwise(F.lit(model.labels[0])) if threshold is not None else F.element_at(labels, F.col("prediction").cast("int") + 1)
            return made.select(*rows.columns, best.alias(f"predicted_{model.label}"), F.map_from_arrays(labels, p).alias(f"predicted_{model.label}_probs"))
        if model.kind in REGRESSORS or model.kind == "MATRIX_FACTORIZATION":
            return made.select(*rows.columns, F.col("prediction").cast("double").alias(f"predicted_{model.label}"))
        if model.kind == "KMEANS":
            return made.select(*rows.columns, (F.col("prediction") + 1).alias("centroid_id"))
        if model.kind == "PCA":
            return made.select(*rows.columns, vector_to_array("__components").alias("principal_components"))
        return self.transform(name, rows)

    def transform(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the model's input as numbers."""
        return self._applied(name, rows).select(*rows.columns, vector_to_array("__features").alias("features"))

    def evaluate(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name)
        if model.kind in CLASSIFIERS:
            scored = self.predict(name, rows).withColumn("__e", F.col(model.label).cast("string"))
            found = metrics.class_metrics(scored, "__e", f"predicted_{model.label}")
            if len(model.labels) == 2:
                margin = self._applied(name, rows).withColumn("__label", (F.col(model.label).cast("string") == model.labels[1]).cast("double"))
                return found.withColumn("roc_auc", F.lit(BinaryClassificationEvaluator(labelCol="__label", rawPredictionCol="rawPrediction").evaluate(margin)))
            return found
        if model.kind in REGRESSORS or model.kind == "MATRIX_FACTORIZATION":
            y, p = F.col(model.label), F.col(f"predicted_{model.label}")
            scored = self.predict(name, rows).filter(y.isNotNull() & ~F.isnan(p))
            return scored.agg(F.avg(F.abs(y - p)).alias("mean_absolute_error"), F.avg((y - p) ** 2).alias("mean_squared_error"), F.median(F.abs(y - p)).alias("median_absolute_error"), (1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y))).alias("r2_score"))
        if model.kind == "KMEANS":
            centres = [[*map(float, v)] for v in model.learner.clusterCenters()]
            if _plain(rows, model.inputs) and len(centres) * len(model.inputs) <= UNROLLED:
                index = clusters.silhouette(_numbers(rows, model.inputs), centres)
            else:
                index = ClusteringEvaluator(featuresCol="__features", weightCol="__weight").evaluate(self._applied(name, _weighted(rows, model.inputs)))
            cost = model.learner.summary.trainingCost if model.cost is None else model.cost
            return self.spark.createDataFrame([(float(index), float(cost))], "silhouette double, training_cost double")
        if model.kind == "PCA":
            return self.spark.createDataFrame([(float(sum(model.learner.explainedVariance)),)], "total_explained_variance_ratio double")
        raise ValueError(f"{model.kind} models can't be evaluated")

    def confusion_matrix(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name, *CLASSIFIERS)
        scored = self.predict(name, rows).withColumn("__e", F.col(model.label).cast("string"))
        return metrics.confusion_matrix(scored, "__e", f"predicted_{model.label}", model.labels)

    def roc_curve(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name, *CLASSIFIERS)
        scored = self.predict(name, rows).select(F.element_at(f"predicted_{model.label}_probs", F.lit(model.labels[1])).alias("score"), (F.col(model.label).cast("string") == model.labels[1]).alias("positive"))
        return metrics.roc_curve(scored, "score", "positive")

    def _columns(self, model: Model, rows: DataFrame) -> list[str]:
        """The names of the places of the assembled vector."""
        attributes = self.known and model.stages.transform(_features(rows, model.inputs)[2]).schema["__features"].metadata["ml_attr"]
        found = sorted((a["idx"], a["name"]) for group in attributes.get("attrs", {}).values() for a in group)
        return [n for _, n in found] or [str(i) for i in range(attributes["num_attrs"])]

    def weights(self, name: str, rows: DataFrame) -> DataFrame:
        """(processed_input, weight); rows: with the model's inputs."""
        model = self._model(name, "LINEAR_REG", "LOGISTIC_REG")
        pairs = [*zip(self._columns(model, rows), map(float, model.learner.coefficients)), ("__INTERCEPT__", float(model.learner.intercept))]
        return self.spark.createDataFrame(pairs, "processed_input string, weight double")

    def advanced_weights(self, name: str, rows: DataFrame) -> DataFrame:
        """(processed_input, weight, standard_error, p_value) of a linear model without a penalty."""
        model = self._model(name, "LINEAR_REG")
        s = model.learner.summary
        names = [*self._columns(model, rows), "__INTERCEPT__"]
        weights = [*map(float, model.learner.coefficients), float(model.learner.intercept)]
        return self.spark.createDataFrame(list(zip(names, weights, map(float, s.coefficientStandardErrors), map(float, s.pValues))), "processed_input string, weight double, standard_error double, p_value double")

    def feature_importance(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name, *(k for k in [*REGRESSORS, *CLASSIFIERS] if "_REG" not in k or "REGRESSOR" in k))
        return self.spark.createDataFrame(list(zip(self._columns(model, rows), map(float, model.learner.featureImportances.toArray()))), "feature string, importance double")

    def global_explain(self, name: str, rows: DataFrame) -> DataFrame:
        """(feature, attribution): the mean size of each input's part in a linear model's predictions."""
        model = self._model(name, "LINEAR_REG", "LOGISTIC_REG")
        parts = self._parts(model, rows)
        return parts.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("attribution"))

    def explain_predict(self, name: str, rows: DataFrame) -> DataFrame:
        """(rows' columns, feature, attribution): a linear model's weight times the distance from the mean."""
        return self._parts(self._model(name, "LINEAR_REG", "LOGISTIC_REG"), rows)

    def _parts(self, model: Model, rows: DataFrame) -> DataFrame:
        made = model.stages.transform(_features(rows, model.inputs)[2]).withColumn("__x", vector_to_array("__features"))
        means = made.agg(F.array(*(F.avg(F.get("__x", F.lit(i))) for i in range(len(model.learner.coefficients)))).alias("m")).first().m
        each = [F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.get("__x", F.lit(i)) - F.lit(m))).alias("attribution")) for i, (n, w, m) in enumerate(zip(self._columns(model, rows), model.learner.coefficients, means))]
        return made.select(*rows.columns, F.inline(F.array(*each)))

    def centroids(self, name: str, rows: DataFrame) -> DataFrame:
        """(centroid_id, feature, numerical_value)."""
        model = self._model(name, "KMEANS")
        names = self._columns(model, rows)
        return self.spark.createDataFrame([(i + 1, n, float(v)) for i, c in enumerate(model.learner.clusterCenters()) for n, v in zip(names, c)], "centroid_id int, feature string, numerical_value double")

    def detect_anomalies(self, name: str, rows: DataFrame, contamination: float) -> DataFrame:
        """rows with their distance from the nearest centroid, or from what the components keep, and whether it is in the top share."""
        model = self._model(name, "KMEANS", "PCA")

        def scored(df: DataFrame) -> DataFrame:
            if model.kind == "KMEANS" and _plain(df, model.inputs):
                # the nearest centroid's distance in generated code; a null counts as not a number
                xs = [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in model.inputs]
                squares = clusters.squares(xs, model.learner.clusterCenters())
                return df.withColumn("distance", F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0]))
            made = self._applied(name, df).withColumn("__x", vector_to_array("__features"))
            if model.kind == "KMEANS":
                centres = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.learner.clusterCenters()))
                near = F.element_at(centres, F.col("prediction") + 1)
            else:
                near = self._rebuilt(model)
            apart = F.sqrt(F.aggregate(F.zip_with("__x", near, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
            return made.withColumn("distance", apart).select(*df.columns, "distance")

        bar = clusters.percentile(scored(rows).select("distance"), 1 - contamination)
        return scored(rows).withColumn("is_anomaly", F.col("distance") > F.lit(bar).cast("double"))

    def _rebuilt(self, model: Model):
        """What the kept components give back of a row."""
        matrix = model.learner.pc.toArray()
        y = vector_to_array("__components")
        return F.array(*(sum((F.get(y, F.lit(k)) * F.lit(float(matrix[i, k])) for k in range(matrix.shape[1])), F.lit(0.0)) for i in range(matrix.shape[0])))

    def reconstruction_loss(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the mean absolute and squared difference from what the components give back."""
        model = self._model(name, "PCA")
        made = self._applied(name, rows).withColumn("__d", F.zip_with(vector_to_array("__features"), self._rebuilt(model), lambda a, b: a - b))
        mean = lambda f: F.aggregate("__d", F.lit(0.0), lambda s, v: s + f(v)) / F.size("__d")
        return made.select(*rows.columns, mean(F.abs).alias("mean_absolute_error"), mean(lambda v: v * v).alias("mean_squared_error"))

    def principal_components(self, name: str, rows: DataFrame) -> DataFrame:
        model = self._model(name, "PCA")
        matrix, names = model.learner.pc.toArray(), self._columns(model, rows)
        return self.spark.createDataFrame([(k, n, float(matrix[i, k])) for k in range(matrix.shape[1]) for i, n in enumerate(names)], "principal_component_id int, feature string, numerical_value double")

    def principal_component_info(self, name: str) -> DataFrame:
        shares = [float(v) for v in self._model(name, "PCA").learner.explainedVariance]
        rows = [(i, s, sum(shares[: i + 1])) for i, s in enumerate(shares)]
        return self.spark.createDataFrame(rows, "principal_component_id int, explained_variance_ratio double, cumulative_explained_variance_ratio double")

    def recommend(self, name: str, users: DataFrame, number: int) -> DataFrame:
        """(user, item, predicted rating) of the best items of each user; a list of bounded length a user."""
        model = self._model(name, "MATRIX_FACTORIZATION")
        user, item = model.inputs
        found = model.learner.recommendForUserSubset(users.select(user).distinct(), number)
        return found.select(user, F.inline("recommendations")).select(user, F.col(item), F.col("rating").alias(f"predicted_{model.label}"))

    def feature_info(self, name: str, rows: DataFrame) -> DataFrame:
        """(input, min, max, mean, median, stddev, category_count, null_count)."""
        return describe_data(rows.select(*self._model(name).inputs))

    def training_info(self, name: str) -> DataFrame:
        """(iteration, loss) of iterative learners; one row with the seconds for others."""
        model = self._model(name)
        try:
            history = list(model.learner.summary.objectiveHistory)
        except (AttributeError, RuntimeError):
            history = []
        return self.spark.createDataFrame([(i, float(v), model.seconds) for i, v in enumerate(history)] or [(0, None, model.seconds)], "iteration int, loss double, duration_seconds double")


def describe_data(rows: DataFrame) -> DataFrame:
    """A row for each column: name, num_rows, num_nulls, num_zeros, min, max, mean, median, stddev, unique_values; one pass."""
    numbers = {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    plain = [c for c, t in rows.dtypes if not t.startswith(("array", "struct", "map"))]
    sums = []
    for c in plain:
        x, n = F.col(c), c in numbers
        v = x.cast("double") if n else F.lit(None).cast("double")
        sums += [F.struct(
            F.lit(c).alias("name"), F.count(F.lit(1)).alias("num_rows"), F.count_if(x.isNull()).alias("num_nulls"), F.count_if(v == 0).alias("num_zeros"), F.min(x).cast("string").alias("min"), F.max(x).cast("string").alias("max"),
            F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("stddev"), F.approx_count_distinct(x, 0.01).alias("unique_values"),
        ).alias(c)]
    return rows.agg(*sums).select(F.inline(F.array(*(F.col(f"`{c}`") for c in plain))))


def _shares(rows: DataFrame, column: str, edges: list[float] | None):
    value = F.col(column).cast("string") if edges is None else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column).cast("double"))).cast("string")
    total = rows.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    counted = rows.filter(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("share"))


def validate_shift(base: DataFrame, study: DataFrame, columns: Sequence[str], threshold: float = 0.3, buckets: int = 10) -> DataFrame:
    """(input, metric, value, threshold, is_anomaly) of each column: skew or drift of study against base.

    Texts by the largest difference of a value's shares, numbers by the Jensen-Shannon divergence of shares of `buckets`
    buckets between base's quantiles.
    """
    kinds, out = dict(base.dtypes), None
    for name in columns:
        text = kinds[name] == "string"
        edges = None if text else [float(e) for e in base.agg(F.percentile(F.col(name).cast("double"), [i / buckets for i in range(1, buckets)]).alias("e")).first().e]
        both = _shares(base, name, edges).withColumnRenamed("share", "p").join(_shares(study, name, edges).withColumnRenamed("share", "q"), "value", "full")
        p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        value = F.max(F.abs(p - q)) if text else F.sum((part(p) + part(q)) / 2)
        row = both.agg(value.alias("value")).select(F.lit(name).alias("input"), F.lit("L_INFTY" if text else "JENSEN_SHANNON_DIVERGENCE").alias("metric"), "value", F.lit(threshold).alias("threshold"), (F.col("value") > threshold).alias("is_anomaly"))
        out = row if out is None else out.unionByName(row)
    return out


def hash_bucketize(x, buckets: int):
    """A bucket from 0 to buckets - 1 by hash, the same everywhere."""
    return F.pmod(F.xxhash64(x), F.lit(buckets))


def multi_hot_encoder(df: DataFrame, column: str, output: str, top_k: int = 32_000, least: int = 1) -> DataFrame:
    """An array column's values as an array of (index, value): indexes by falling frequency, 0 for all others."""
    counted = df.select(F.explode(F.array_distinct(column)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = [r.v for r in counted.filter(F.col("v").isNotNull()).orderBy(F.desc("n"), "v").limit(top_k).collect()]
    index = F.map_from_arrays(F.array(*map(F.lit, kept)), F.array(*(F.lit(i + 1) for i in range(len(kept))))) if kept else F.create_map(F.lit(""), F.lit(0))
    places = F.array_sort(F.array_distinct(F.transform(F.filter(column, lambda v: v.isNotNull()), lambda v: F.coalesce(F.try_element_at(index, v), F.lit(0)))))
    return df.withColumn(output, F.transform(places, lambda i: F.struct(i.alias("index"), F.lit(1.0).alias("value"))))


def lp_norm(x, p: float):
    x = F.col(x) if isinstance(x, str) else x
    size = lambda v: F.abs(v.cast("double"))
    if p == float("inf"):
        return F.array_max(F.transform(x, size))
    return F.pow(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(size(v), F.lit(float(p)))), F.lit(1.0 / p))


def distance(x, y, kind: str = "EUCLIDEAN"):
    """EUCLIDEAN, MANHATTAN or COSINE, of arrays of numbers."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    x, y = x.cast("array<double>"), y.cast("array<double>")
    total = lambda f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    if kind == "COSINE":
        return 1 - total(lambda a, b: a * b) / (lp_norm(x, 2) * lp_norm(y, 2))
    return F.sqrt(total(lambda a, b: (a - b) * (a - b))) if kind == "EUCLIDEAN" else total(lambda a, b: F.abs(a - b))


def label_texts(model: Model) -> IndexToString:
    """The labels' texts of a classifier's predictions, as a stage of a pipeline."""
    return IndexToString(inputCol="prediction", outputCol=f"predicted_{model.label}", labels=model.labels)
