"""MLlib classifiers over household features.

Rows are households, so training data is small next to the readings; it is
read from the materialised feature table and dealt to a few partitions,
which keeps the per-iteration job overhead of tree boosting low. Models are
``PipelineModel``s whose first stage (the assembler) carries the feature list.
"""
from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.schema import LEGACY_FEATURES, RATIO_FLOOR, TRAIN_FEATURES

LABEL = "is_high_risk"

# Fixed hyperparameters of the two models (the trainer's settings).
RF_PARAMS = dict(numTrees=100, maxDepth=8, seed=42)
GBT_PARAMS = dict(maxIter=150, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
TEST_SIZE, SEED = 0.2, 42
# Boosting runs a short job for each level of each tree, whose cost is its tasks' overhead more than their
# rows; a forest runs few long ones.
ROWS_PER_PARTITION = {"rf": 20_000, "gbt": 100_000}


def assemble(features: Sequence[str] = TRAIN_FEATURES, out: str = "features") -> VectorAssembler:
    """Fixed-order feature vector; invalid values are an error, as in the trainer."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def feature_vector(hf: DataFrame, features: Sequence[str] = TRAIN_FEATURES) -> DataFrame:
    """The assembled vector, a row for each household and position."""
    v = assemble(features).transform(hf)
    return v.select("household_id", F.posexplode(vector_to_array("features")).alias("position", "value"))


def legacy_features(hf: DataFrame) -> DataFrame:
    """Inputs of a model that carries no feature list, a row for each household and position."""
    return feature_vector(hf, LEGACY_FEATURES)


def fit_scaler(train: DataFrame, features: Sequence[str] = TRAIN_FEATURES) -> DataFrame:
    """Mean and population deviation of each feature over the training rows; 1 for a constant feature."""
    moments = train.agg(*[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features])
    rows = moments.select(F.posexplode(F.array(*[F.col(f) for f in features])).alias("position", "m"))
    std = F.when(F.col("m.std") > 1e-9 * F.greatest(F.abs("m.mean"), F.lit(1.0)), F.col("m.std")).otherwise(F.lit(1.0))
    names = F.array(*[F.lit(f) for f in features])
    return rows.select("position", F.get(names, F.col("position")).alias("feature"), "m.mean", std.alias("std"))


def scale_features(scaler: DataFrame, data: DataFrame, features: Sequence[str] = TRAIN_FEATURES) -> DataFrame:
    """(value - mean) / std by a fitted or loaded scaler, a row for each household and position.

    The scaler has a row for each feature, so Spark broadcasts it by its size.
    """
    rows = feature_vector(data, features).join(scaler.select("position", "mean", "std"), "position")
    return rows.select("household_id", "position", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))


def with_weights(train: DataFrame, kind: str) -> DataFrame:
    """Row weights: 'balanced' n / (2 n_class) for the forest; positives weighted
    neg/pos (1.0 if no positive) for boosting. Counts enter as one scalar subquery."""
    st = train.select(F.struct(F.count(F.lit(1)).alias("n"),
                               F.count(F.when(F.col(LABEL) == 1, 1)).alias("pos"),
                               F.count(F.when(F.col(LABEL) == 0, 1)).alias("neg"))).scalar()
    lab = F.col(LABEL)
    if kind == "balanced":
        w = F.when(lab == 1, st["n"] / (2.0 * st["pos"])).otherwise(st["n"] / (2.0 * st["neg"]))
    else:
        ratio = F.when(st["pos"] > 0, st["neg"] / st["pos"].cast("double")).otherwise(F.lit(1.0))
        w = F.when(lab == 1, ratio).otherwise(F.lit(1.0))
    return train.withColumn("w", w.cast("double"))


def constant_model(spark: SparkSession, features: Sequence[str], value: float) -> PipelineModel:
    """Single-class guard: a model that outputs a constant probability (0 or 1)."""
    sql = (f"SELECT *, array({1.0 - value}, {value}) AS _p, CAST({int(value)} AS DOUBLE) AS prediction FROM __THIS__")
    return Pipeline(stages=[assemble(features), SQLTransformer(statement=sql)]).fit(
        spark.createDataFrame([], "x int").select(
            *[F.lit(0.0).alias(f) for f in features]))


def train(train_df: DataFrame, kind: str = "rf", features: Sequence[str] = TRAIN_FEATURES,
          params: dict | None = None) -> PipelineModel:
    """Fit a forest ('rf') or boosted trees ('gbt') on labelled households."""
    counts = {r[0]: r[1] for r in train_df.groupBy(LABEL).count().collect()}  # one row per class
    classes = list(counts)
    n = sum(counts.values())
    # the partitions, which bagging depends on, follow from the data alone: the same model on any cluster
    parts = max(1, -(-n // ROWS_PER_PARTITION.get(kind, n or 1)))
    df = train_df.repartition(parts, "household_id").sortWithinPartitions("household_id")
    if len(classes) < 2:
        return constant_model(train_df.sparkSession, features, float(classes[0]) if classes else 0.0)
    if kind == "rf":
        est = RandomForestClassifier(featuresCol="features", labelCol=LABEL, weightCol="w",
                                     **{**RF_PARAMS, **(params or {})})
        df = with_weights(df, "balanced")
    elif kind == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol=LABEL, weightCol="w",
                            **{**GBT_PARAMS, **(params or {})})
        df = with_weights(df, "pos_ratio")
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    df = df.cache()
    try:
        return Pipeline(stages=[assemble(features), est]).fit(df)
    finally:
        df.unpersist()


def model_features(model: PipelineModel) -> list[str]:
    """The assembler stage carries the feature list; legacy models without one get J20's list."""
    for st in model.stages:
        if isinstance(st, VectorAssembler):
            return list(st.getInputCols())
    return list(LEGACY_FEATURES)


def score(model: PipelineModel, hf: DataFrame, name: str, label: str | None = LABEL) -> DataFrame:
    """Probability of class 1 and predicted class per household."""
    feats = model_features(model)
    x = hf.select("household_id", *([F.col(label).alias("label")] if label else [F.lit(None).cast("int").alias("label")]),
                  *[F.col(f) if f in hf.columns else F.lit(0.0).alias(f) for f in feats])
    out = model.transform(x)
    prob = F.col("_p")[1] if "_p" in out.columns else vector_to_array("probability")[1]
    return out.select("household_id", "label", prob.cast("double").alias("score"),
                      F.col("prediction").cast("int").alias("prediction"), F.lit(name).alias("model"))


def feature_importance(spark: SparkSession, models: dict[str, PipelineModel], a: str = "rf", b: str = "gbt") -> DataFrame:
    """Importance per feature for two models and their difference (b - a)."""
    rows = []
    feats = model_features(models[a])
    imp = {}
    for name in (a, b):
        last = models[name].stages[-1]
        vals = list(last.featureImportances.toArray()) if hasattr(last, "featureImportances") else [0.0] * len(feats)
        imp[name] = vals
    for i, f in enumerate(feats):
        rows.append((f, float(imp[a][i]), float(imp[b][i]), float(imp[b][i] - imp[a][i])))
    df = spark.createDataFrame(rows, f"feature string, {a} double, {b} double, difference double")
    return df.orderBy(F.desc(a), "feature")


def model_card(split_df: DataFrame, kinds: Sequence[str] = ("rf", "gbt")) -> DataFrame:
    """(model, key, value) rows: hyperparameters, split sizes, test share and seed."""
    spark = split_df.sparkSession
    params = {"rf": {**RF_PARAMS, "class_weight": "balanced"}, "gbt": {**GBT_PARAMS, "pos_weight": "neg/pos"}}
    rows = [(k, key, str(v)) for k in kinds for key, v in params[k].items()]
    rows += [(k, key, str(v)) for k in kinds for key, v in (("test_size", TEST_SIZE), ("random_state", SEED))]
    static = spark.createDataFrame(rows, "model string, key string, value string")
    sizes = split_df.agg(F.count(F.when(F.col("is_test") == 0, 1)).alias("tr"),
                         F.count(F.when(F.col("is_test") == 1, 1)).alias("te"))
    dyn = sizes.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("model"), "tr", "te").selectExpr(
        "model", "stack(2, 'training_samples', CAST(tr AS STRING), 'test_samples', CAST(te AS STRING)) as (key, value)")
    return static.unionByName(dyn)


# --- what-if scenarios (J17) ---------------------------------------------------------------
SLIDER_FEATURES = ["avg_usage", "max_usage", "std_usage", "night_avg_usage",
                   "avg_spike_ratio", "max_spike_ratio", "std_spike_ratio"]


@dataclass(frozen=True)
class Scenario:
    name: str
    feature: str
    op: str             # 'set' or 'mul'
    value: float
    household_id: str | None = None   # None = every household


def _apply_ops(df: DataFrame) -> DataFrame:
    """Recompute the derived features the way the what-if panel does: divisor is
    the (edited) overall mean floored at 0.01, not the day mean."""
    day_est = F.greatest(F.col("avg_usage"), F.lit(RATIO_FLOOR))
    return df.withColumns({"night_day_ratio": F.col("night_avg_usage") / day_est,
                           "usage_range": F.col("max_usage") - F.col("avg_usage"),
                           "cv_usage": F.col("std_usage") / day_est})


def whatif(hf_live: DataFrame, scenarios: Sequence[Scenario], models: dict[str, PipelineModel]) -> DataFrame:
    """Batch what-if scoring: (scenario, household, model, score, prediction, delta).

    Global scenarios fan out by exploding the (user-given, bounded) scenario
    names on each household row; household scenarios join on the household id.
    Edits are pivoted to one row per (scenario, household or all). Each row is
    scored twice, edited and as it was; delta is the difference.
    """
    spark = hf_live.sparkSession
    bad = [s for s in scenarios if s.op not in ("set", "mul") or s.feature not in SLIDER_FEATURES]
    if bad:
        raise ValueError(f"invalid scenarios: {bad}")
    spec = spark.createDataFrame([(s.name, s.household_id, s.feature, s.op, float(s.value)) for s in scenarios],
                                 "scenario string, sh string, feature string, op string, value double")
    wide = spec.groupBy("scenario", "sh").agg(*[
        F.max(F.when(F.col("feature") == f, F.struct("op", "value"))).alias(f"_{f}") for f in SLIDER_FEATURES])
    base = hf_live.select("household_id", *SLIDER_FEATURES)
    global_names = sorted({s.name for s in scenarios if s.household_id is None})
    parts = []
    if global_names:
        g = base.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in global_names])))
        parts.append(g.join(wide.where(F.col("sh").isNull()).drop("sh"), "scenario"))
    if any(s.household_id is not None for s in scenarios):
        hs = wide.where(F.col("sh").isNotNull()).withColumnRenamed("sh", "household_id")
        parts.append(base.join(hs, "household_id"))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.withColumn("_before", F.struct(*SLIDER_FEATURES))
    for f in SLIDER_FEATURES:
        e = F.col(f"_{f}")
        x = x.withColumn(f, F.when(e["op"] == "set", e["value"]).when(e["op"] == "mul", F.col(f) * e["value"])
                         .otherwise(F.col(f)))
    x = x.drop(*[f"_{f}" for f in SLIDER_FEATURES])
    out = []
    for name, m in models.items():
        edited = scored_again(m, _apply_ops(x), "score", "_edited")
        back = edited.withColumns({f: F.col(f"_before.{f}") for f in SLIDER_FEATURES})
        both = scored_again(m, _apply_ops(back), "_base", "_class")
        out.append(both.select("scenario", "household_id", F.lit(name).alias("model"), "score", F.col("_edited").alias("prediction"),
                               (F.col("score") - F.col("_base")).alias("delta")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def scored_again(model: PipelineModel, x: DataFrame, score_col: str, class_col: str) -> DataFrame:
    """``x`` with one more model's score and class, and none of the model's own columns."""
    kept = x.columns
    x = x.withColumns({f: F.lit(0.0) for f in model_features(model) if f not in kept})
    out = model.transform(x)
    prob = F.col("_p")[1] if "_p" in out.columns else vector_to_array("probability")[1]
    return out.select(*kept, prob.cast("double").alias(score_col), F.col("prediction").cast("int").alias(class_col))


# --- persistence (A7) and cross-validation (K11) --------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def registry_tag(key: tuple) -> str:
    import hashlib
    return hashlib.sha1(repr(key).encode()).hexdigest()[:20]


def publish_model(spark: SparkSession, model: PipelineModel, path: str) -> None:
    """Save to a fresh folder, then rename into place: readers never see half a model."""
    jvm = spark._jvm  # noqa: SLF001 - Hadoop FS has no public Python API
    conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    if fs.exists(dst):  # already published for this key
        return
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    model.write().save(tmp)
    fs.mkdirs(dst.getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), dst) and not fs.exists(dst):
        raise OSError(f"could not publish {tmp} to {path}")


def load_model(path: str) -> PipelineModel | None:
    """None when the model is missing or unreadable (the dashboard's behaviour)."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - any load failure means 'no model'
        return None


def cross_validate(labelled: DataFrame, scratch: str, folds: int = 5, seed: int = SEED, kind: str = "rf",
                   features: Sequence[str] = TRAIN_FEATURES) -> DataFrame:
    """K-fold AUC; fold = hash(id:seed) mod k.

    The rows with their fold are written once under ``scratch``; the folds' fits run
    side by side, each a distributed fit, so a cluster isn't left idle by one fit's
    small jobs. Every held-out household is scored once, one exact AUC is taken by fold.
    """
    from hydrolens.operators.evaluation import auc_roc
    fold = (F.conv(F.substring(F.md5(F.concat(F.col("household_id"), F.lit(f":{seed}"))), 1, 8), 16, 10)
             .cast("long") % folds)
    labelled.withColumn("fold", fold.cast("int")).write.parquet(scratch)
    data = labelled.sparkSession.read.parquet(scratch)
    fit = inheritable_thread_target(data.sparkSession)(lambda k: train(data.where(F.col("fold") != k), kind, features))
    with ThreadPoolExecutor(folds) as pool:
        models = list(pool.map(fit, range(folds)))
    held = [score(m, data.where(F.col("fold") == k), str(k)) for k, m in enumerate(models)]
    every = held[0]
    for h in held[1:]:
        every = every.unionByName(h)
    sizes = every.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(auc_roc(every), "model").select(F.col("model").cast("int").alias("fold"), F.lit(kind).alias("model"), "n", "auc")


_models: dict[tuple, PipelineModel] = {}
_models_lock = threading.Lock()
_key_locks: dict[tuple, threading.Lock] = {}


def memo_model(key: tuple, build) -> PipelineModel:
    """Fit once per (data version, kind, parameters) in this process; models of other keys are fitted meanwhile."""
    with _models_lock:
        lock = _key_locks.setdefault(key, threading.Lock())
    with lock:
        if key not in _models:
            _models[key] = build()
        return _models[key]


def side_by_side(spark: SparkSession, build, kinds: Sequence[str] = ("rf", "gbt")) -> dict[str, PipelineModel]:
    """``build`` of each kind at once: a forest's few long jobs fill the cores that boosting's many short ones leave idle."""
    with ThreadPoolExecutor(len(kinds)) as pool:
        return dict(zip(kinds, pool.map(inheritable_thread_target(spark)(build), kinds), strict=True))
