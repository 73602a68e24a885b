"""Traffic-type, mode and protocol models, and their evaluation.

Up to ``LOCAL_ROWS`` rows, each tree or boosted class is grown by one task (``operators/trees.py``); beyond that, model fits are
MLlib's own distributed jobs. Splits and folds are ranks of a seeded hash within a
class, so they are the same on every cluster; ranks go through slices, so a class with most of the
rows is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culvert.functions.numeric import half_even, ratio
from culvert.operators.flows import FEATURES
from culvert.operators.parameters import STRUCTURAL
from culvert.operators.trees import Trees, grow, numbers
from culvert.plans.skew import one_row, sliced_rank

# Model settings and confidence thresholds.
FOREST = {"numTrees": 150, "maxDepth": 16}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.9}
SETTINGS = {"rf": FOREST, "gbt": BOOSTED}
PROTOCOL_FOREST = {"numTrees": 50, "maxDepth": 9}
ABSTAIN_BELOW, MODE_MIN, PROTOCOL_MIN = 0.6, 0.7, 0.6
VOLUME_FEATURES = ("pkt_total", "rate_pps", "flow_duration_sec")
MODE_FEATURES = (*FEATURES, "is_ipv6", "is_aead", "block_8")
FOLDS_AT_ONCE = 5
#: a forest is fitted by one task for so many rows: each task sends statistics of every open node, whatever its rows
ROWS_A_TASK = 1 << 17
#: a task that grows trees holds so many rows at most, of a byte for each feature and 8 for places
LOCAL_ROWS = 1 << 21
HASH_SPACE, HASH_SLICE = 1 << 30, 1 << 15


def training_table(flows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Busiest flow per labelled capture with its label; ``flows`` has one row per key."""
    return flows.join(labels, key).filter("pkt_total > 0")


def feature_matrix(df: DataFrame, names: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    """Vector of the named features in fixed order, missing values as 0."""
    filled = df.select("*", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_f_{n}") for n in names])
    vec = VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol=out).transform(filled)
    return vec.drop(*[f"_f_{n}" for n in names])


def _class_rank(df: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    h = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(HASH_SPACE))
    return sliced_rank(df.withColumn("_h", h), [label], "_h", HASH_SLICE, "_rank", key).drop("_h")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], seed: int = 0, shares=(0.70, 0.15)) -> DataFrame:
    """Add ``part``: train, val or test, with the shares held inside every class."""
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _class_rank(df, label, key, seed).join(F.broadcast(totals), label)  # one row per class
    place = (F.col("_rank") + 0.5) / F.col("_n")
    part = F.when(place < shares[0], "train").when(place < shares[0] + shares[1], "val").otherwise("test")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    return _class_rank(df, label, key, seed).withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups per fold, sizes balanced: largest group first into the smallest fold.

    Only the groups' sizes (one row per configuration, a fixed grid) reach the driver.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).collect()
    load, rows = [0] * k, []
    for r in sizes:
        target = min(range(k), key=lambda i: (load[i], i))
        load[target] += r["n"]
        rows.append((r[group], target))
    table = df.sparkSession.createDataFrame(rows, f"{group} string, fold int")
    return df.join(F.broadcast(table), group)  # one row per configuration of the grid


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = n / (classes x class size)."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    classes = Window.partitionBy()  # over one row per class
    share = F.sum("_c").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("_c"))
    weights = sizes.select(label, share.alias("weight"))
    return train.join(F.broadcast(weights), label)  # one row per class


INFO = "algo string, version string, features array<string>, means map<string,double>"


@dataclass
class Model:
    """Trees, or a fitted pipeline (label index, forest or boosted trees), with what inference needs."""

    pipeline: PipelineModel | None
    algo: str
    version: str
    features: tuple[str, ...]
    means: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None

    @property
    def classes(self) -> list[str]:
        if self.trees is not None:
            return self.trees.classes
        return next(s for s in self.pipeline.stages if isinstance(s, StringIndexerModel)).labels

    @property
    def importances(self) -> dict[str, float]:
        """Global importance per feature; empty for one-versus-rest boosting."""
        if self.trees is not None:
            return {} if self.trees.boosted else {n: round(float(v), 5) for n, v in zip(self.features, self.trees.importances())}
        tree = self.pipeline.stages[-1]
        if not hasattr(tree, "featureImportances"):
            return {}
        return {n: round(float(v), 5) for n, v in zip(self.features, tree.featureImportances)}

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        if self.trees is not None:
            spark.createDataFrame(self.trees.table()).write.mode("overwrite").parquet(f"{path}/trees")
        else:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = [(self.algo, self.version, list(self.features), self.means, self.trees is not None)]
        spark.createDataFrame(row, f"{INFO}, own boolean").write.mode("overwrite").json(f"{path}/info")

    @classmethod
    def load(cls, path: str) -> Model:
        spark = SparkSession.getActiveSession()
        info = spark.read.schema(f"{INFO}, own boolean").json(f"{path}/info").first()
        trees = Trees.of(spark.read.parquet(f"{path}/trees").collect()) if info["own"] else None
        return cls(None if info["own"] else PipelineModel.load(f"{path}/pipeline"), info["algo"], info["version"], tuple(info["features"]), dict(info["means"] or {}), trees)

    def info(self) -> dict:
        return {"trained": True, "algo": self.algo, "model_version": self.version, "classes": self.classes, "feature_importance": self.importances}


def fit(
    train: DataFrame, label: str, algo: str = "rf", features: Sequence[str] = FEATURES, version: str = "dev", seed: int = 0, **settings
) -> Model:
    """Fit a class-weighted forest (``rf``) or one-versus-rest boosted trees (``gbt``)."""
    if algo not in SETTINGS:
        raise ValueError(f"unknown algorithm {algo}")
    chosen = {**SETTINGS[algo], **settings}
    if set(chosen) == set(SETTINGS[algo]) and train.count() <= LOCAL_ROWS:
        own = {"trees": chosen["numTrees"]} if algo == "rf" else {"trees": chosen["maxIter"], "step": chosen["stepSize"], "share": chosen["subsamplingRate"]}
        trees = grow(train, label, features, algo == "gbt", seed, depth=chosen["maxDepth"], **own)
        return Model(None, algo, f"{version}-{algo}", tuple(features), feature_means(train, features), trees)
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    if algo == "rf":
        tree = RandomForestClassifier(labelCol="_label", featuresCol="features", weightCol="weight", seed=seed, **chosen)
    else:
        base = GBTClassifier(labelCol="_label", featuresCol="features", seed=seed, **chosen)
        tree = OneVsRest(classifier=base, labelCol="_label", featuresCol="features", parallelism=FOLDS_AT_ONCE)
    train = few_parts(train)
    table = feature_matrix(balanced_weights(train, label), features)
    return Model(Pipeline(stages=[index, tree]).fit(table), algo, f"{version}-{algo}", tuple(features), feature_means(train, features))


def few_parts(train: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """``train``, which should be stored, in one partition for so many rows; never in more than it has."""
    return train.coalesce(max(1, -(-train.count() // rows)))


def feature_means(train: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    row = mean_row(train, features).first()
    return {n: row[n] for n in features if row[n] is not None}


def mean_row(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean per feature. Features have four decimals, so they are summed as integers: exact in any order."""
    whole = [F.sum(half_even(F.col(n).cast("double") * 10000.0).cast("decimal(20,0)")).cast("double") for n in features]
    n = F.count(F.lit(1)).cast("double")
    return train.agg(*[half_even(t / n / 10000.0, 6).alias(name) for t, name in zip(whole, features)])


def predict_array(df: DataFrame, model: Model) -> DataFrame:
    """Add ``_p``, the probabilities; boosted one-versus-rest has raw margins only, so they pass through softmax."""
    if model.trees is not None:
        scored = df.withColumn("_raw", model.trees.scorer(df.sparkSession)(F.struct(*numbers(model.features))))
        raw = F.col("_raw")
    else:
        scored = model.pipeline.stages[-1].transform(feature_matrix(df, model.features))
        raw = vector_to_array("probability" if model.algo == "rf" else "rawPrediction")
    if model.algo != "rf":
        powers = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        raw = F.transform(powers, lambda x: x / total)
    out = scored.withColumn("_p", raw)
    return out.drop(*[c for c in ("features", "rawPrediction", "probability", "prediction", "_raw") if c in out.columns and c not in df.columns])


def predict(df: DataFrame, model: Model, seen: Column | None = None) -> DataFrame:
    """Add the ``traffic`` struct: class, rounded confidence, abstain flag, model version."""
    scored = predict_array(df, model)
    p = F.col("_p")
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_max(p)
    label = F.element_at(names, F.array_position(p, best).cast("int"))
    confidence = half_even(best, 4)
    guess = F.struct(label.alias("predicted_type"), confidence.alias("confidence"), (confidence < ABSTAIN_BELOW).alias("abstained"), F.lit(model.version).alias("model_version"))
    if seen is not None:
        nothing = F.struct(F.lit("Other").alias("predicted_type"), F.lit(0.0).alias("confidence"), F.lit(False).alias("abstained"), F.lit("no-esp-observed").alias("model_version"))
        guess = F.when(seen, guess).otherwise(nothing)
    return scored.withColumn("traffic", guess).drop("_p")


def classifier(model: Model):
    """A ``classify`` step for ``operators.analysis``: reads the ``flow`` struct."""

    def step(sessions: DataFrame) -> DataFrame:
        flat = sessions.withColumns({n: F.col(f"flow.{n}") for n in FEATURES})
        return predict(flat, model, F.col("has_esp")).drop(*FEATURES)

    return step


def select_model(train: DataFrame, val: DataFrame, label: str, algos: Sequence[str] = ("rf", "gbt"), **kw) -> tuple[Model, float]:
    """The algorithm with the higher macro-F1 on ``val``; the first wins a tie."""
    best, best_f1 = None, -1.0
    for algo in algos:
        settings = kw.get(algo, {})
        model = fit(train, label, algo, seed=kw.get("seed", 0), **settings)
        pred = predict(val, model).select(F.col(label).alias("label"), F.col("traffic.predicted_type").alias("prediction"))
        f1 = overall_metrics(pred).first()["f1_macro"]
        if f1 > best_f1:
            best, best_f1 = model, f1
    return best, best_f1


# --- explanations ---------------------------------------------------------------------------------


def explain(df: DataFrame, model: Model, key: Sequence[str], top: int = 3) -> DataFrame:
    """Features that supported each prediction most: swap one for its training mean, keep the drops.

    Thirteen variants per row are scored in one pass; the top is an ordered aggregate per row.
    """
    key = list(key)
    if not model.means:
        ranked = sorted(model.importances.items(), key=lambda kv: -kv[1])[:top]
        total = sum(w for _, w in ranked) or 1.0
        rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), F.lit(round(w / total, 4)).alias("weight")) for n, w in ranked])
        return df.select(*key, F.explode(rows).alias("e")).select(*key, "e.*")
    names = model.features
    base = df.select(*key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    scored = predict_array(base, model)
    best = F.array_max("_p")
    scored = scored.select(*key, *names, F.array_position("_p", best).cast("int").alias("_at"), best.alias("_p0"))
    variants = scored.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    swapped = [F.when(F.col("_i") == i, F.lit(float(model.means.get(n, 0.0)))).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)]
    values = F.array(*[F.col(n) for n in names])
    again = predict_array(variants.select(*key, "_at", "_p0", "_i", F.get(values, F.col("_i")).alias("value"), *swapped), model)
    drop = (F.col("_p0") - F.element_at("_p", F.col("_at"))).alias("drop")
    drops = again.select(*key, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("feature"), "value", drop).filter("drop > 0")
    bounded = drops.groupBy(*key).agg(F.collect_list(F.struct((-F.col("drop")).alias("o"), "feature", "value", "drop")).alias("d"))
    first = F.slice(F.array_sort("d"), 1, top)
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + x["drop"])
    return bounded.select(*key, total.alias("_t"), F.explode(first).alias("e")).select(
        *key, "e.feature", "e.value", half_even(F.col("e.drop") / F.col("_t"), 4).alias("weight")
    )


# --- metrics --------------------------------------------------------------------------------------


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 per true class (0 where undefined)."""
    c = confusion_counts(pred)
    cells = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
        )
    )
    sums = c.select(cells.alias("x")).select("x.*").groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "actual", "predicted")])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    f1 = ratio(F.col("tp") * 2, F.col("actual") + F.col("predicted"))
    return sums.select("class", F.col("actual").alias("support"), half_even(p, 4).alias("precision"), half_even(r, 4).alias("recall"), half_even(f1, 4).alias("f1"))


def overall_metrics(pred: DataFrame) -> DataFrame:
    """Rows, accuracy and macro-F1 over the classes that occur as true labels."""
    totals = confusion_counts(pred).agg(
        F.sum("n").alias("n"), half_even(ratio(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n")), 4).alias("accuracy")
    )
    macro = class_metrics(pred).filter("support > 0").agg(half_even(F.sum(F.col("f1").cast("decimal(12,4)")).cast("double") / F.count(F.lit(1)).cast("double"), 4).alias("f1_macro"))
    return one_row(totals, macro)


def confusion_matrix(pred: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every label x label cell, zeros included, as a pivot with fixed columns; ``other`` counts further predictions."""
    named = confusion_counts(pred).withColumn("prediction", F.when(F.col("prediction").isin(*labels), F.col("prediction")).otherwise("other"))
    wide = named.groupBy("label").pivot("prediction", [*labels, "other"]).agg(F.sum("n"))
    return wide.na.fill(0, subset=[*labels, "other"])


def confusion_pairs(pred: DataFrame) -> DataFrame:
    return confusion_counts(pred).filter(F.col("label") != F.col("prediction")).orderBy(F.desc("n"), "label", "prediction")


def fit_folds(df: DataFrame, label: str, fold: str, features: Sequence[str] = FEATURES, parallel: int = FOLDS_AT_ONCE, **settings) -> list[tuple[object, Model]]:
    """One forest per value of ``fold``, fit on all other rows; ``parallel`` fits run at the same time.

    ``df`` should be a stored table, since every fit reads it. A fold that leaves fewer than two classes to learn from is
    left out. With a fair scheduler each fit gets a pool of its own, so that no fit waits for another's last tasks.
    """
    table = df.filter(F.col(label).isNotNull())
    seen: dict[object, set] = {}
    for value, name in table.select(fold, label).distinct().collect():  # folds or groups x classes: a fixed grid
        seen.setdefault(value, set()).add(name)
    rest = {v: set().union(*[names for other, names in seen.items() if other != v]) for v in seen}
    values = sorted((v for v, names in rest.items() if v is not None and len(names) >= 2))

    def one(value):
        df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{value}")
        return value, fit(table.filter(~F.col(fold).eqNullSafe(value)), label, "rf", features, **settings)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(one), values))


def out_of_fold(df: DataFrame, models: Sequence[tuple[object, Model]], fold: str) -> DataFrame:
    """Every row of a fitted fold with the ``traffic`` of the one model that did not learn from it."""
    parts = [predict(df.filter(F.col(fold) == value), model) for value, model in models]
    if not parts:
        raise ValueError("no fold leaves two classes to learn from")
    return reduce(DataFrame.unionByName, parts)


def explain_out_of_fold(df: DataFrame, models: Sequence[tuple[object, Model]], fold: str, key: Sequence[str], top: int = 3) -> DataFrame:
    """``explain`` of every row by the model of its own fold."""
    if not models:
        raise ValueError("no fold leaves two classes to learn from")
    return reduce(DataFrame.unionByName, [explain(df.filter(F.col(fold) == value), model, key, top) for value, model in models])


def cross_validate(df: DataFrame, label: str, fold: str, features: Sequence[str] = FEATURES, **settings) -> DataFrame:
    """Pooled (label, prediction, fold) rows: each fold predicted by a model fit on the others.

    ``fold`` may be a fold number or a group to hold out whole; a fold that leaves fewer than two
    classes to learn from is skipped.
    """
    pred = out_of_fold(df, fit_folds(df, label, fold, features, **settings), fold)
    return pred.select(F.col(label).alias("label"), F.col("traffic.predicted_type").alias("prediction"), F.col(fold).cast("string").alias("held_out"))


def without_volume(features: Sequence[str] = FEATURES) -> tuple[str, ...]:
    return tuple(f for f in features if f not in VOLUME_FEATURES)


def write_evaluation(pred: DataFrame, labels: Sequence[str], model: Model, path: str) -> None:
    """Metrics and confusion matrix as JSON files."""
    per_class = class_metrics(pred).withColumn("model_version", F.lit(model.version))
    per_class.write.mode("overwrite").json(f"{path}/class_metrics")
    overall_metrics(pred).withColumn("model_version", F.lit(model.version)).write.mode("overwrite").json(f"{path}/metrics")
    confusion_matrix(pred, labels).write.mode("overwrite").json(f"{path}/confusion_matrix")


def read_evaluation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: spark.read.json(f"{path}/{k}") for k in ("metrics", "class_metrics", "confusion_matrix")}


def choose_table(captured: DataFrame, fallback: DataFrame) -> tuple[DataFrame, str]:
    """The captured table if it has rows, else the fallback, with its name."""
    return (fallback, "fallback") if captured.isEmpty() else (captured, "captured")


# --- inference that fills gaps --------------------------------------------------------------------


def mode_features(df: DataFrame, ip_version: str = "ike.ip_version", encryption: str = "ike.encryption") -> DataFrame:
    enc = F.upper(F.coalesce(encryption, F.lit("")))
    return df.withColumns(
        {
            "is_ipv6": (F.col(ip_version) == "IPv6").cast("int").cast("double"),
            "is_aead": (enc.contains("GCM") | enc.contains("CCM")).cast("int").cast("double"),
            "block_8": enc.contains("DES").cast("int").cast("double"),
        }
    )


def _with_ike(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    names = df.schema["ike"].dataType.fieldNames()
    fields = [changes.get(n, F.col(f"ike.{n}")).alias(n) for n in names]
    fields += [c.alias(n) for n, c in changes.items() if n not in names]
    return df.withColumn("ike", F.struct(*fields))


def fill_mode(sessions: DataFrame, guess: Column, confidence: Column, eligible: Column) -> DataFrame:
    """Fill an unknown mode of sessions that own packets, when the guess is sure enough."""
    take = eligible & (F.col("ike.mode") == "unknown") & F.coalesce(confidence >= MODE_MIN, F.lit(False))
    fields = F.array_sort(F.array_union("ike.inferred_fields", F.array(F.lit("mode"))))
    return _with_ike(
        sessions,
        {
            "mode": F.when(take, guess).otherwise(F.col("ike.mode")),
            "mode_confidence": F.when(take, confidence),
            "inferred_fields": F.when(take, fields).otherwise(F.col("ike.inferred_fields")),
        },
    )


def fill_from_structure(sessions: DataFrame, encryption: Column, dh_group: Column, confidence: Column, has_sa_init: Column) -> DataFrame:
    """Fill unknown cipher and group from a structural guess, marked as inferred."""
    sure = has_sa_init & F.coalesce(confidence >= PROTOCOL_MIN, F.lit(False))
    gap_e, gap_d = sure & (F.col("ike.encryption") == "unknown"), sure & (F.col("ike.dh_group") == "unknown")
    added = F.filter(F.array(F.when(gap_e, F.lit("encryption")), F.when(gap_d, F.lit("dh_group"))), lambda x: x.isNotNull())
    return _with_ike(
        sessions,
        {
            "encryption": F.when(gap_e, encryption).otherwise(F.col("ike.encryption")),
            "dh_group": F.when(gap_d, dh_group).otherwise(F.col("ike.dh_group")),
            "inferred_fields": F.when(gap_e | gap_d, F.array_sort(F.array_union("ike.inferred_fields", added))).otherwise(F.col("ike.inferred_fields")),
            "confidence_source": F.when(gap_e | gap_d, "classifier").otherwise("parser"),
        },
    )


def fit_protocol(train: DataFrame, **settings) -> tuple[Model, Model]:
    """Cipher and group forests over the structural features."""
    kw = {**PROTOCOL_FOREST, **settings}
    return fit(train, "encryption", "rf", STRUCTURAL, "structure", **kw), fit(train, "dh_group", "rf", STRUCTURAL, "structure", **kw)


def predict_protocol(df: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """Add guessed cipher and group; confidence is the smaller of the two winning shares."""
    out = df
    for name, model in zip(("encryption", "dh_group"), models):
        out = predict(out, model).withColumns({f"guess_{name}": F.col("traffic.predicted_type"), f"_c_{name}": F.col("traffic.confidence")}).drop("traffic")
    return out.withColumn("guess_confidence", F.least("_c_encryption", "_c_dh_group")).drop("_c_encryption", "_c_dh_group")


