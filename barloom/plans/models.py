"""Model formulations on keyed boosting: all series, folds, formulations and variants are one fit.

A model enters the evaluation only through a ``score`` column: the probability of a take profit, or the predicted return. Fitted
models are rows (``operators.boosting``): they are stored, joined to bars and compared like any table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators import boosting
from barloom.operators.folds import fold_slices
from barloom.operators.layout import with_position
from barloom.operators.splits import temporal_split
from barloom.plans.config import FORMULATIONS
from barloom.schemas import SERIES_KEYS
from barloom.session import cut_lineage

#: Loss of each formulation.
OBJECTIVES = {"binary_homerun": "binary", "multiclass_3": "softmax", "regression_return": "pseudo_huber"}
LABELS = ("target", "target_ret")
RUN_KEYS = ("variant", "formulation")


@dataclass(frozen=True)
class Hyper:
    n_trees: int = 100
    max_depth: int = 3
    learning_rate: float = 0.05


def _check(formulation: str) -> None:
    if formulation not in FORMULATIONS:
        raise ValueError(f"unknown formulation {formulation!r}; available: {sorted(FORMULATIONS)}")


def model_specs(
    keys: DataFrame, feature_sets: Mapping[str, Sequence[str]], columns: Sequence[str], formulations: Sequence[str] = tuple(FORMULATIONS),
    hyper: Hyper = Hyper(), labels: Sequence[str] = LABELS,
) -> DataFrame:
    """One spec per key, variant and formulation. ``columns`` is the feature vector, a variant uses part of it."""
    options = []
    for variant, features in feature_sets.items():
        for name in formulations:
            _check(name)
            options.append(
                F.struct(
                    F.lit(variant).alias("variant"),
                    F.lit(name).alias("formulation"),
                    F.lit(OBJECTIVES[name]).alias("objective"),
                    F.lit(list(labels).index(FORMULATIONS[name].label)).alias("label"),
                    F.lit(hyper.n_trees).alias("n_trees"),
                    F.lit(hyper.max_depth).alias("max_depth"),
                    F.lit(float(hyper.learning_rate)).alias("learning_rate"),
                    F.array(*[F.lit(list(columns).index(c)) for c in features]).alias("features"),
                )
            )
    return keys.withColumn("_s", F.explode(F.array(*options))).select(*keys.columns, "_s.*")


def model_scorer(
    ready: DataFrame,
    bounds: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    formulations: Sequence[str] = tuple(FORMULATIONS),
    hyper: Hyper = Hyper(),
) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``walkforward.evaluate``: one model per series, fold, formulation and variant, fitted in one job.

    ``feature_sets`` maps a variant (``CONTROL``, ``TREATMENT``) to its features. The validation part of a fold stops the boosting.
    Run keys of the result: ``variant`` and ``formulation``.
    """
    columns = sorted({c for cols in feature_sets.values() for c in cols})
    keys = [*SERIES_KEYS, "fold"]

    def scorer(slices: DataFrame) -> DataFrame:
        held = cut_lineage(slices)
        train = fold_slices(ready, bounds, ("train",), ("ts", "close", "atr_14", "target", "close_ahead", "target_ret", *columns))
        rows = train.select(*keys, *LABELS, *columns, F.lit(False).alias("_val")).unionByName(
            held.filter("part = 'val'").select(*keys, *LABELS, *columns, F.lit(True).alias("_val"))
        )
        samples = boosting.samples_of(rows, keys, columns, LABELS, F.col("_val"))
        usable = bounds.filter("skipped_reason IS NULL").select(*keys)
        fitted = boosting.fit(samples, model_specs(usable, feature_sets, columns, formulations, hyper), keys)
        return boosting.score(held, cut_lineage(fitted), keys, columns, RUN_KEYS, F.expr(f"rn div {boosting.BLOCK}"))

    return scorer


def split_scorer(
    labelled: DataFrame, features: Sequence[str], swing: int, embargo: int | None = None, split_swing: int | None = None, hyper: Hyper = Hyper()
) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``jobs.naive_vs_model``: one model per series, fitted on its training split, stopped by validation."""
    placed = temporal_split(labelled, swing, swing if embargo is None else embargo, split_swing).filter("split IN ('train', 'val')")
    samples = boosting.samples_of(placed, SERIES_KEYS, features, LABELS[:1], F.col("split") == "val")
    series = labelled.select(*SERIES_KEYS).distinct()
    fitted = cut_lineage(boosting.fit(samples, model_specs(series, {"CONTROL": features}, features, ("binary_homerun",), hyper), SERIES_KEYS))
    return lambda rows: boosting.score(rows, fitted, SERIES_KEYS, features, (), F.expr(f"rn div {boosting.BLOCK}"))


def holdout(dataset: DataFrame) -> DataFrame:
    """``_val``: the last ``min(30, 10 %)`` rows of a series, if these are at least ten."""
    placed = dataset if "n_bars" in dataset.columns else with_position(dataset)
    size = F.least(F.lit(30), F.floor(F.col("n_bars") * 0.1))
    return placed.withColumn("_val", (size >= 10) & (F.col("rn") >= F.col("n_bars") - size))


def production_models(
    dataset: DataFrame, feature_sets: Mapping[str, Sequence[str]], hyper: Hyper = Hyper(), keys: Sequence[str] = SERIES_KEYS
) -> DataFrame:
    """Final models of all series in one job: a row per series and feature set (``variant``)."""
    columns = sorted({c for cols in feature_sets.values() for c in cols})
    placed = holdout(dataset)
    samples = boosting.samples_of(placed, keys, columns, LABELS[:1], F.col("_val"))
    series = dataset.select(*keys).distinct()
    names = F.array(*[F.lit(c) for c in columns])
    fitted = boosting.fit(samples, model_specs(series, feature_sets, columns, ("binary_homerun",), hyper), keys)
    return fitted.withColumn("columns", names)


@dataclass(frozen=True)
class Fitted:
    """One fitted model, a row of ``boosting.fit``: called on rows with its features it adds ``score``."""

    model: dict
    columns: tuple[str, ...]
    formulation: str

    def __call__(self, df: DataFrame) -> DataFrame:
        m, names = self.model, [*df.columns, "score"]
        schema = StructType([*df.schema, *StructType.fromDDL("score double")])
        vector = F.array(*[F.col(c).cast("double") for c in self.columns])

        def run(batches):
            for batch in batches:
                x = boosting._matrix(pa.chunked_array([batch.column("_x")]))
                margin = boosting.margins(x, m["outputs"], m["max_depth"], m["feature"], m["threshold"], m["leaf"])
                score = boosting.predicted(m["objective"], margin) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(score)], names=names)

        return df.withColumn("_x", vector).mapInArrow(run, schema)


def fit(train: DataFrame, val: DataFrame, formulation: str, features: Sequence[str], hyper: Hyper = Hyper()) -> Fitted:
    """Fit one formulation on one table; the validation rows, if there are any, stop boosting early."""
    _check(formulation)
    label = FORMULATIONS[formulation].label
    columns = [*features, label]
    rows = train.select(*columns, F.lit(False).alias("_val")).unionByName(val.select(*columns, F.lit(True).alias("_val")))
    samples = boosting.samples_of(rows.withColumn("_k", F.lit(0)), ["_k"], features, [label], F.col("_val"))
    key = train.sparkSession.range(1).select(F.lit(0).alias("_k"))
    specs = model_specs(key, {"CONTROL": features}, features, (formulation,), hyper, (label,))
    return Fitted(boosting.fit(samples, specs, ["_k"]).first().asDict(), tuple(features), formulation)


def production_fit(dataset: DataFrame, features: Sequence[str], hyper: Hyper = Hyper()) -> Fitted:
    """Final model of one series: the last ``min(30, 10 %)`` rows, if at least ten, stop the boosting."""
    placed = holdout(dataset)
    return fit(placed.filter("NOT _val"), placed.filter("_val"), "binary_homerun", features, hyper)


MODEL_ROW = f"{boosting.SPEC}, {boosting.TREES}, columns array<string>, formulation string"


def save_bundle(fitted: Fitted, metadata: DataFrame, path: str) -> None:
    """The fitted model as a row, and its one-row table of threshold, barriers and features."""
    row = {**fitted.model, "columns": list(fitted.columns), "formulation": fitted.formulation}
    schema = StructType.fromDDL(MODEL_ROW)
    metadata.sparkSession.createDataFrame([tuple(row[f.name] for f in schema)], schema).write.mode("overwrite").parquet(f"{path}/model")
    metadata.withColumn("formulation", F.lit(fitted.formulation)).write.mode("overwrite").json(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[Fitted, DataFrame]:
    row = spark.read.schema(MODEL_ROW).parquet(f"{path}/model").first().asDict()
    return Fitted(row, tuple(row["columns"]), row["formulation"]), spark.read.json(f"{path}/metadata")
