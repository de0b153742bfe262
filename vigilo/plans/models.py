"""Binary classifiers on Spark ML.

Each model is a ``Pipeline(FeaturePreparer, classifier)`` fitted on the
training rows of the split; fitting runs as Spark jobs (gradient or
histogram aggregation on executors), scoring is ``transform``.

Mapping of the reference's settings (defaults of the public functions):

==============  =====================================================
logistic        LogisticRegression, no penalty, 2000 iterations,
                balanced weights, no internal standardisation
ridge / lasso   regParam = 1 / (C · Σw), elasticNet 0 / 1, C = 0.1
cart            DecisionTree depth 8, balanced weights
random_forest   RandomForest 200 trees depth 12, sqrt features
lightgbm        LeafwiseBooster (plans/boosting.py): 300 rounds, step 0.1,
                31 leaves, ≥20 rows per leaf, positives weighted n_neg/n_pos
mlp             NetworkClassifier (plans/network.py): 128-128 ReLU, dropout
                0.3, Adam, halving on plateau, early stop on the validation
                hold-out (unweighted: the reference's per-row weighting had
                no effect)
==============  =====================================================
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import decide
from vigilo.operators.sampling import fit_rows, validation_holdout
from vigilo.plans.boosting import LeafwiseBooster
from vigilo.plans.network import NetworkClassifier
from vigilo.plans.features import balanced_weights, default_preparer, unbalance_weights

LINEAR = ("logistic", "ridge", "lasso")
TREES = ("cart", "random_forest", "lightgbm")
ALL_MODELS = LINEAR + TREES + ("mlp",)


def classifier(name: str, n_train_weight: float | None = None, **over):
    """The Spark ML estimator for a reference model key."""
    common = dict(featuresCol="features", labelCol="label")
    if name in LINEAR:
        reg = 0.0
        if name != "logistic":
            c = over.pop("C", C.PENALTY_C)
            reg = 1.0 / (c * (n_train_weight or 1.0))
        kw = dict(regParam=reg, elasticNetParam=1.0 if name == "lasso" else 0.0,
                  maxIter=C.LOGISTIC_MAX_ITER, standardization=False, weightCol="weight",
                  family="binomial")
        kw.update(over)
        return LogisticRegression(**common, **kw)
    if name == "cart":
        kw = dict(maxDepth=C.CART_DEPTH, weightCol="weight", seed=C.SEED, maxBins=256)
        kw.update(over)
        return DecisionTreeClassifier(**common, **kw)
    if name == "random_forest":
        # A row's node in each tree is kept: at no level are the trees walked from the root again.
        kw = dict(numTrees=C.FOREST_TREES, maxDepth=C.FOREST_DEPTH, featureSubsetStrategy="sqrt",
                  weightCol="weight", seed=C.SEED, maxBins=256, cacheNodeIds=True)
        kw.update(over)
        return RandomForestClassifier(**common, **kw)
    if name == "lightgbm":
        kw = dict(idCol=C.KEY, maxIter=C.BOOST_ROUNDS, seed=C.SEED)
        kw.update(over)
        return LeafwiseBooster(**kw)
    if name == "mlp":
        kw = dict(idCol=C.KEY, hidden=C.MLP_HIDDEN, patience=C.MLP_PATIENCE, seed=C.SEED)
        kw.update(over)
        return NetworkClassifier(**kw)
    raise ValueError(f"unknown model {name!r}")


def weighted(train: DataFrame, name: str) -> DataFrame:
    """The class weighting each model uses (M7 balanced, M8 is_unbalance)."""
    if name == "lightgbm":
        return unbalance_weights(train)
    if name == "mlp":
        return train.withColumn("weight", F.lit(1.0))
    return balanced_weights(train)


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col(C.LABEL).cast("double"))


def fit(train: DataFrame, name: str, prep_model=None, rows: int | None = None, **over) -> PipelineModel:
    """Fit preparation + classifier on all training rows.

    A caller may bound them to about ``rows``, the same share of either class;
    the bound holds for the fit alone, never for what is scored or viewed.
    Raises if a class has no rows.

    ``prep_model`` lets several models share one fitted preparation of the
    same training rows (it is deterministic, so refitting it per model would
    only repeat the work). The classifier trains on the transformed vectors,
    persisted once for its iterations and released afterwards. The network sets
    the validation share of the rows (R4) aside for its rate and its end.
    """
    data = with_label(weighted(fit_rows(train, rows), name))
    if name == "mlp":
        data = validation_holdout(data)
    if prep_model is None:
        prep_model = default_preparer(train.columns).fit(data)
    return PipelineModel([prep_model, _classified(prep_model.transform(data), name, over)])


def fit_vectors(vectors: DataFrame, name: str, prep_model, **over) -> PipelineModel:
    """As :func:`fit`, on rows (key, class, label, features) that ``prep_model``
    has prepared and the caller holds: models of the same rows prepare them once."""
    data = weighted(vectors, name)
    return PipelineModel([prep_model, _classified(validation_holdout(data) if name == "mlp" else data, name, over)])


def _classified(prepared: DataFrame, name: str, over: dict):
    """The classifier, fitted on the weighted vectors, which are held meanwhile."""
    feats = prepared.select(C.KEY, "features", "label", "weight", *(["is_val"] if name == "mlp" else [])).persist()
    try:
        n_w = feats.agg(F.sum("weight")).first()[0] if name in ("ridge", "lasso") else None
        return classifier(name, n_w, **over).fit(feats)
    finally:
        feats.unpersist()


def score(model: PipelineModel, df: DataFrame, name: str, keep=()) -> DataFrame:
    """C8 + P17: (model, VAERS_ID, y, p, pred) — p is P(class 1)."""
    out = model.transform(df)
    return out.select(F.lit(name).alias("model"), C.KEY, F.col(C.LABEL).cast("int").alias("y"),
                      vector_to_array("probability")[1].alias("p"), *keep).withColumn("pred", decide("p"))


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].feature_names()


def coefficients(spark: SparkSession, models: dict[str, PipelineModel]) -> DataFrame:
    """(model, feature, value, rank by |value| desc) for linear models."""
    rows = []
    for name, m in models.items():
        clf = m.stages[-1]
        if not hasattr(clf, "coefficients"):
            continue
        names = feature_names(m)
        vals = clf.coefficients.toArray().tolist()
        if len(vals) != len(names):
            raise ValueError(f"{name}: {len(vals)} values for {len(names)} features")
        order = sorted(range(len(vals)), key=lambda i: (-abs(vals[i]), names[i]))
        rows += [(name, names[i], float(vals[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "model string, feature string, value double, rank int")


def importances(spark: SparkSession, models: dict[str, PipelineModel]) -> DataFrame:
    """(model, feature, value, rank) from the trees' impurity importances."""
    rows = []
    for name, m in models.items():
        clf = m.stages[-1]
        if not hasattr(clf, "featureImportances"):
            continue
        names = feature_names(m)
        vals = clf.featureImportances.toArray().tolist()
        if len(vals) != len(names):
            raise ValueError(f"{name}: {len(vals)} values for {len(names)} features")
        order = sorted(range(len(vals)), key=lambda i: (-vals[i], names[i]))
        rows += [(name, names[i], float(vals[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "model string, feature string, value double, rank int")


def split_importances(spark: SparkSession, name: str, model: PipelineModel) -> DataFrame:
    """C12, split-count flavour (the reference booster's default): how many
    internal nodes of the ensemble split on each feature, ranked."""
    from vigilo.operators.explain import ensemble_tables
    names = feature_names(model)
    trees, _ = ensemble_tables(model.stages[-1], spark)
    counts = [0] * len(names)
    for t in trees:
        for f in t["feature"][t["left"] >= 0]:
            counts[int(f)] += 1
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    rows = [(name, names[i], float(counts[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "model string, feature string, value double, rank int")


def top_by_rank(table: DataFrame, k: int = C.TOP_FEATURES) -> DataFrame:
    """The k best-ranked features per model."""
    return table.where(F.col("rank") <= k)


def training_history(spark: SparkSession, model: PipelineModel, name: str) -> DataFrame:
    """C14 for the network: loss, accuracy and AUC of each epoch on its training
    rows and on the hold-out it has not learned from."""
    return model.stages[-1].history_table(spark, name)
