"""Models a channel can have, by name; plugins add their own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import hybrid, linear, quality, stats


class Model(Protocol):
    """Fit gives one row a channel, predict adds trend, stored and loaded go to and from the archive's params."""

    name: str

    def fit(self, rows: DataFrame) -> DataFrame: ...

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame: ...


def prepared(model: Model, rows: DataFrame) -> DataFrame:
    """What a model is trained on: its own view of the samples, where it has one."""
    return model.prepare(rows) if hasattr(model, "prepare") else rows


def floored(sigma: DataFrame, fitted: DataFrame) -> DataFrame:
    """sigma is at least the model's own floor."""
    if "floor" not in fitted.columns:
        return sigma
    keys = [c for c in ("mnemonic", "state") if c in sigma.columns and c in fitted.columns]
    return sigma.join(fitted.select(*keys, "floor"), keys).withColumn("sigma", F.greatest("sigma", "floor")).drop("floor")


class ConstantModel:
    """F01, F02, F03."""

    name = "default"

    def fit(self, rows: DataFrame) -> DataFrame:
        return linear.constant_fit(rows, ["mnemonic"])

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        return rows.join(fitted.select("mnemonic", F.col("mu").alias("trend")), "mnemonic")

    def stored(self, fitted: DataFrame) -> Column:
        return F.array("mu")

    def loaded(self, models: DataFrame) -> DataFrame:
        return models.withColumn("mu", F.get("params", F.lit(0)))


class DiscreteModel(ConstantModel):
    """the mean, and a sigma of at least the distance between the most frequent values."""

    name = "discrete"

    def fit(self, rows: DataFrame) -> DataFrame:
        kept = rows.where("dqf = 1") if "dqf" in rows.columns else rows
        delta = stats.discrete_delta(stats.value_counts(kept, ["mnemonic"]), ["mnemonic"])
        return super().fit(rows).join(delta.select("mnemonic", F.col("delta").alias("floor")), "mnemonic", "left").fillna(0.0, ["floor"])


class CounterModel(ConstantModel):
    """a constant over the rates of a counter, resets counting nothing; without a model the trend is 0."""

    name = "lmtrend"

    def __init__(self, sample_period: float = 80.0) -> None:
        self.sample_period = sample_period

    def prepare(self, rows: DataFrame) -> DataFrame:
        return quality.counter_rate(rows, self.sample_period)

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        return rows.join(fitted.select("mnemonic", "mu"), "mnemonic", "left").withColumn("trend", F.coalesce("mu", F.lit(0.0))).drop("mu")


class BasisModel:
    """Linear in the features that `basis` makes of a row."""

    def __init__(self, name: str, basis: Column, ridge: float = 0.0, intercept: bool = False) -> None:
        self.name, self.basis, self.ridge, self.intercept = name, basis, ridge, intercept

    def fit(self, rows: DataFrame) -> DataFrame:
        kept = rows.where("dqf = 1") if "dqf" in rows.columns else rows
        return linear.gram_fit(kept, ["mnemonic"], self.basis, ridge=self.ridge, intercept=self.intercept)

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        basis = F.concat(F.array(F.lit(1.0)), self.basis) if self.intercept else self.basis
        return linear.predict(rows, fitted, ["mnemonic"], basis)

    def stored(self, fitted: DataFrame) -> Column:
        return F.col("params")

    def loaded(self, models: DataFrame) -> DataFrame:
        return models


class HybridModel:
    """a model of its own for each state; states are few and named, the channels of a state fit together."""

    def __init__(self, states: DataFrame, by_state: dict[str, Model], rest: Model | None = None, name: str = "hybrid") -> None:
        self.name, self.states, self.models = name, states, {"default": rest or ConstantModel(), **by_state}

    def prepare(self, rows: DataFrame) -> DataFrame:
        return hybrid.split(rows, self.states)

    def fit(self, rows: DataFrame) -> DataFrame:
        out = None
        for state, model in self.models.items():
            one = model.fit(rows.where(F.col("state") == state))
            floor = F.col("floor") if "floor" in one.columns else F.lit(0.0)
            part = one.select("mnemonic", F.lit(state).alias("state"), model.stored(one).alias("params"), floor.alias("floor"))
            out = part if out is None else out.unionByName(part)
        return out

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        out = None
        for state, model in self.models.items():
            mine = model.loaded(fitted.where(F.col("state") == state).drop("state", "floor"))
            part = model.predict(rows.where(F.col("state") == state), mine).select(*rows.columns, "trend")
            out = part if out is None else out.unionByName(part)
        return out

    def stored(self, fitted: DataFrame) -> Column:
        return F.col("params")

    def loaded(self, models: DataFrame) -> DataFrame:
        return models.withColumn("floor", F.lit(0.0))


#: Models by name; a plugin adds its own.
MODELS: dict[str, Model] = {m.name: m for m in (ConstantModel(), DiscreteModel(), CounterModel())}


def register(model: Model) -> None:
    MODELS[model.name] = model
