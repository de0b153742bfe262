"""Feature preparation as a Spark ML Estimator/Model pair (M1–M8).

``FeaturePreparer.fit`` learns, from the training rows only,
  * the exact median of each numeric column (M2),
  * mean and population sd after imputation, sd 0 → 1 (M3),
  * the sorted category list of each categorical column (M5);
``FeaturePreparerModel.transform`` then builds standardised numerics and
zero-filled binaries (M4) as column expressions, and looks up each category's
place: in a list, or beyond ``SHORT_LIST`` categories in a table joined by
value, so that a column with very many costs a join and a sparse vector, not an
expression for each. One-hot parts drop
the first category (unknown → all zeros); everything is assembled into one
vector. ``named`` and ``long`` write every feature out and are for few.

Spark's own Imputer/StandardScaler/OneHotEncoder differ on exactly these
points (approximate median, sample sd, no drop-first), hence this stage.
Being a pipeline stage, it is refitted inside every CV fold.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo import config as C
from vigilo.functions.clean import fill_unknown
from vigilo.operators.distributed import exact_percentiles

SHORT_LIST = 1_000               # categories that are searched in the row; more are joined
MAX_CATEGORIES = 5_000_000       # names of a model's features, on the driver as its coefficients are


class _PrepParams(HasOutputCol):
    numCols = Param(Params._dummy(), "numCols", "numeric columns", TypeConverters.toListString)
    binCols = Param(Params._dummy(), "binCols", "0/1 columns", TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "categorical columns", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(numCols=[], binCols=[], catCols=[], outputCol="features")


class FeaturePreparer(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):

    @keyword_only
    def __init__(self, numCols=None, binCols=None, catCols=None, outputCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FeaturePreparerModel":
        num = self.getOrDefault("numCols")
        cat = self.getOrDefault("catCols")
        medians, means, sds = fit_numeric(df, num)
        cats = fit_categories(df, cat)
        m = FeaturePreparerModel(numCols=num, binCols=self.getOrDefault("binCols"), catCols=cat,
                                 outputCol=self.getOrDefault("outputCol"))
        m._set(medians=medians, means=means, stds=sds, categories=json.dumps(cats))
        return m


class FeaturePreparerModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "training medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means after imputation", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population sds (0 → 1)", TypeConverters.toListFloat)
    categories = Param(Params._dummy(), "categories", "JSON: column → sorted categories",
                       TypeConverters.toString)

    @keyword_only
    def __init__(self, numCols=None, binCols=None, catCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(medians=[], means=[], stds=[], categories="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    # -- names and expressions ------------------------------------------------
    def category_map(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault("categories"))

    def feature_names(self) -> list[str]:
        """M6: numeric, binary, then one-hot 'col_value' names, in vector order."""
        cats = self.category_map()
        onehot = [f"{c}_{v}" for c in self.getOrDefault("catCols") for v in cats.get(c, [])[1:]]
        return list(self.getOrDefault("numCols")) + list(self.getOrDefault("binCols")) + onehot

    def raw_feature_of(self) -> dict[str, str]:
        """Feature name → the raw column it came from (for W7)."""
        cats = self.category_map()
        out = {c: c for c in list(self.getOrDefault("numCols")) + list(self.getOrDefault("binCols"))}
        for c in self.getOrDefault("catCols"):
            for v in cats.get(c, [])[1:]:
                out[f"{c}_{v}"] = c
        return out

    def feature_exprs(self, onehot: bool = True) -> list:
        num = self.getOrDefault("numCols")
        meds, means, sds = (self.getOrDefault(p) for p in ("medians", "means", "stds"))
        exprs = [(F.coalesce(F.col(c).cast("double"), F.lit(md)) - F.lit(mu)) / F.lit(sd)
                 for c, md, mu, sd in zip(num, meds, means, sds)]
        exprs += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.getOrDefault("binCols")]
        cats = self.category_map() if onehot else {}
        for c in self.getOrDefault("catCols"):
            filled = fill_unknown(c)
            exprs += [(filled == F.lit(v)).cast("double") for v in cats.get(c, [])[1:]]
        return exprs

    def named(self, df: DataFrame, keep=(C.KEY,)) -> DataFrame:
        """Transformed features as named double columns (plus ``keep``)."""
        return df.select(*keep, *[e.alias(n) for e, n in zip(self.feature_exprs(), self.feature_names())])

    def long(self, df: DataFrame, keep=(C.KEY,)) -> DataFrame:
        """Transformed features in long form (keep…, feature, value).

        One explode of (name, value) pairs: names are never resolved as
        columns, so one-hot names that differ only by case stay distinct.
        """
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), e.alias("value"))
                          for e, n in zip(self.feature_exprs(), self.feature_names())])
        return df.select(*keep, F.explode(pairs).alias("_fv")).select(*keep, "_fv.feature", "_fv.value")

    def _place(self, df: DataFrame, c: str, values: list[str], out: str) -> DataFrame:
        """Add a category's place among the kept ones; the first one and unknown
        ones get the place behind the last, which the encoder drops."""
        dropped = len(values) - 1
        if len(values) <= SHORT_LIST:
            at = F.array_position(F.array(*[F.lit(v) for v in values[1:]]), fill_unknown(c))
            return df.withColumn(out, F.when(at > 0, at - 1).otherwise(dropped).cast("double"))
        table = df.sparkSession.createDataFrame(
            pd.DataFrame({f"{out}_v": values[1:], f"{out}_i": [float(i) for i in range(dropped)]}),
            f"{out}_v string, {out}_i double")
        joined = df.join(table, fill_unknown(c) == F.col(f"{out}_v"), "left")
        return joined.withColumn(out, F.coalesce(F.col(f"{out}_i"), F.lit(float(dropped)))).drop(f"{out}_v", f"{out}_i")

    def _encoder(self, spark, sizes: list[int]) -> OneHotEncoderModel:
        """Encoder of that many categories a column, learned from each one's last place."""
        if getattr(self, "_fitted_encoder", None) is None:
            names = [f"_place{k}" for k in range(len(sizes))]
            last = spark.createDataFrame([tuple(float(n - 1) for n in sizes)], ", ".join(f"{c} double" for c in names))
            self._fitted_encoder = OneHotEncoder(inputCols=names, outputCols=[f"_hot{k}" for k in range(len(sizes))], dropLast=True).fit(last)
        return self._fitted_encoder

    def _transform(self, df: DataFrame) -> DataFrame:
        plain = self.feature_exprs(onehot=False)
        cats = self.category_map()
        wide = [c for c in self.getOrDefault("catCols") if len(cats.get(c, [])) > 1]
        tmp = [f"_feat{i}" for i in range(len(plain))]
        out = df.withColumns(dict(zip(tmp, plain)))
        for k, c in enumerate(wide):
            out = self._place(out, c, cats[c], f"_place{k}")
        if wide:
            out = self._encoder(df.sparkSession, [len(cats[c]) for c in wide]).transform(out)
        hot = [f"_hot{k}" for k in range(len(wide))]
        out = VectorAssembler(inputCols=tmp + hot, outputCol=self.getOrDefault("outputCol")).transform(out)
        # Without the encoder's notes on its columns: trees would split 0/1 features by category, not by threshold.
        out = out.withMetadata(self.getOrDefault("outputCol"), {})
        return out.drop(*tmp, *hot, *[f"_place{k}" for k in range(len(wide))])


def fit_numeric(df: DataFrame, num: list[str]) -> tuple[list[float], list[float], list[float]]:
    """Exact medians (one distributed percentile job over all columns), then
    mean and population sd of the imputed values (one aggregate)."""
    if not num:
        return [], [], []
    long = df.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot([], num, "feature", "v")
    med_rows = exact_percentiles(long, "v", [0.5], ["feature"]).collect()
    med = {r["feature"]: r["q"] for r in med_rows}
    medians = [float(med.get(c) if med.get(c) is not None else 0.0) for c in num]
    imputed = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(num, medians)]
    row = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(imputed)],
                 *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(imputed)]).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(num))]
    sds = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(num))]
    return medians, means, sds


def fit_categories(df: DataFrame, cat: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per categorical column (NULL → 'Unknown').

    One distinct-pairs job, read with a limit one past the bound: the names of
    a model's features are on the driver, as its coefficients are.
    """
    if not cat:
        return {}
    pairs = (df.select(*[fill_unknown(c).alias(c) for c in cat])
               .unpivot([], cat, "feature", "value").distinct())
    got = pairs.limit(MAX_CATEGORIES + 1).collect()          # bounded read, one pass
    if len(got) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories: over the one-hot bound")
    out: dict[str, list[str]] = {c: [] for c in cat}
    for r in got:
        out[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def default_preparer(columns) -> FeaturePreparer:
    """The reference's feature groups, restricted to present columns."""
    have = set(columns)
    sym = [c for c in columns if c.startswith(C.SYM_PREFIX)]
    return FeaturePreparer(numCols=[c for c in C.NUM_FEATURES if c in have],
                           binCols=[c for c in C.BIN_COLS if c in have] + sym,
                           catCols=[c for c in C.CAT_FEATURES if c in have])


def balanced_weights(df: DataFrame, label: str = C.LABEL, out: str = "weight") -> DataFrame:
    """M7: weight n / (k · n_class) per row (k = 2 classes)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy()                                       # over ≤ 2 rows
    w = counts.select(label, (F.sum("_nc").over(every)
                              / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)


def unbalance_weights(df: DataFrame, label: str = C.LABEL, out: str = "weight") -> DataFrame:
    """M8: positives weighted n_neg / n_pos, negatives 1."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    w = r.select(F.explode(F.array(
        F.struct(F.lit(1).alias(label), (F.col("_q") / F.col("_p")).alias(out)),
        F.struct(F.lit(0).alias(label), F.lit(1.0).alias(out)))).alias("s")).select("s.*")
    return df.join(F.broadcast(w), df[label].cast("int") == w[label]).drop(w[label])
