"""Train-only preprocessing: learn a few numbers per column, apply them as one projection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlast.functions.ordering import grouped_quantiles, long_columns
from outlast.sources.schema import CATEGORICAL, NOT_PREDICTORS


def predictor_columns(df: DataFrame, categorical: list[str] = CATEGORICAL,
                      exclude: list[str] = NOT_PREDICTORS) -> tuple[list[str], list[str]]:
    """(numeric, categorical) predictors, in the column order of ``df``."""
    used = [c for c in df.columns if c not in exclude]
    return [c for c in used if c not in categorical], [c for c in used if c in categorical]


# Expressions are written as SQL text: one call to the JVM per column instead of a dozen.

def _finite(column: str) -> str:
    value = f"CAST(`{column}` AS DOUBLE)"
    return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def finite(column: str) -> Column:
    """The value as a double; null, NaN and infinities all count as missing."""
    return F.expr(_finite(column))


def _safe(name: str) -> str:
    return re.sub(r"\W", "_", name)


@dataclass(frozen=True)
class ColumnStats:
    """What training says about one numeric column; moments are over the values present."""

    rows: int
    present: int
    mean: float
    variance: float
    median: float

    def imputed(self) -> tuple[float, float]:
        """Mean and population deviation once the missing values have become the median."""
        share = self.present / self.rows
        mean = share * self.mean + (1 - share) * self.median
        spread = share * (self.variance + (self.mean - mean) ** 2) + (1 - share) * (self.median - mean) ** 2
        return mean, spread ** 0.5

    def indicator(self) -> tuple[float, float]:
        share = 1 - self.present / self.rows
        return share, (share * (1 - share)) ** 0.5


def numeric_statistics(train: DataFrame, columns: list[str]) -> dict[str, ColumnStats]:
    """Counts, moments and exact medians of many columns; one row per column reaches the driver."""
    long = long_columns(train.select(*[finite(c).alias(c) for c in columns]), columns)
    rows = train.count()
    moments = [F.count("value").alias("present"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")]
    medians = grouped_quantiles(long, ["column"], "value", [0.5])
    table = long.groupBy("column").agg(*moments).join(
        medians.withColumnRenamed("_q0", "median"), "column", "left")
    found = {r["column"]: r for r in table.collect()}
    stats = {}
    for c in columns:
        r = found.get(c)
        if r is None or not r["present"]:
            stats[c] = ColumnStats(rows, 0, 0.0, 0.0, 0.0)
        elif r["median"] is None:
            raise ValueError(f"no median found for {c!r}")
        else:
            stats[c] = ColumnStats(rows, r["present"], r["mean"], r["variance"], r["median"])
    return stats


@dataclass(frozen=True)
class Preprocessor:
    """Learned values. ``medians`` leaves out columns without any value in the training rows."""

    medians: dict[str, float]
    missing: list[str]
    categories: dict[str, list[str]]
    modes: dict[str, str]
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    # -- fitting ------------------------------------------------------------------------------
    @staticmethod
    def fit(train: DataFrame, scale: bool, numeric: list[str] | None = None,
            categorical: list[str] | None = None) -> "Preprocessor":
        found_numeric, found_categorical = predictor_columns(train)
        numeric = found_numeric if numeric is None else numeric
        categorical = found_categorical if categorical is None else categorical
        categories, modes = category_levels(train, categorical)
        if not numeric:
            return Preprocessor({}, [], categories, modes)
        stats = numeric_statistics(train, numeric)
        known = [c for c in numeric if stats[c].present > 0]
        missing = [c for c in numeric if stats[c].present < stats[c].rows]
        medians = {c: stats[c].median for c in known}
        if not scale:
            return Preprocessor(medians, missing, categories, modes)
        imputed = {c: stats[c].imputed() for c in known}
        imputed.update({f"{c}_missing": stats[c].indicator() for c in missing})
        centers = {n: center for n, (center, _) in imputed.items()}
        scales = {n: s if s > 1e-12 * max(1.0, abs(centers[n])) else 1.0 for n, (_, s) in imputed.items()}
        return Preprocessor(medians, missing, categories, modes, centers, scales)

    # -- applying -----------------------------------------------------------------------------
    def numeric_outputs(self) -> list[str]:
        return list(self.medians) + [f"{c}_missing" for c in self.missing]

    def level_outputs(self) -> dict[tuple[str, str], str]:
        """Name of the column of each (categorical, level). A name that is taken, in any case, gets a number."""
        taken, names = {n.lower() for n in self.numeric_outputs()}, {}
        for c, levels in self.categories.items():
            for v in levels:
                first = name = f"{c}_{_safe(v)}"
                number = 1
                while name.lower() in taken:
                    number += 1
                    name = f"{first}_{number}"
                taken.add(name.lower())
                names[c, v] = name
        return names

    def outputs(self) -> list[str]:
        return self.numeric_outputs() + list(self.level_outputs().values())

    def sql(self) -> dict[str, str]:
        """Output column name to SQL expression over the raw predictors."""
        out = {c: f"coalesce({_finite(c)}, {_number(m)})" for c, m in self.medians.items()}
        out.update({f"{c}_missing": f"CAST(({_finite(c)}) IS NULL AS DOUBLE)" for c in self.missing})
        for name in self.centers:
            out[name] = f"({out[name]} - {_number(self.centers[name])}) / {_number(self.scales[name])}"
        for (c, v), name in self.level_outputs().items():
            out[name] = f"CAST(coalesce(`{c}`, {_quoted(self.modes[c])}) = {_quoted(v)} AS DOUBLE)"
        return out

    def expressions(self) -> dict[str, Column]:
        return {name: F.expr(text) for name, text in self.sql().items()}

    def weighted_sum(self, weights: dict[str, float]) -> Column:
        outputs = self.sql()
        return F.expr(" + ".join(f"({outputs[n]}) * {_number(w)}" for n, w in weights.items()) or "0.0D")

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in NOT_PREDICTORS if c in df.columns] if keep is None else keep
        return df.select(*keep, *[e.alias(n) for n, e in self.expressions().items()])

    @staticmethod
    def identity(names: list[str]) -> "Preprocessor":
        """For columns that are already preprocessed."""
        return Preprocessor({n: 0.0 for n in names}, [], {}, {})

    def to_table(self, spark) -> DataFrame:
        """The learned values as rows, so a fitted preprocessor is stored like any other table."""
        rows = [("median", c, None, float(v)) for c, v in self.medians.items()]
        rows += [("missing", c, None, None) for c in self.missing]
        rows += [("level", c, v, float(v == self.modes[c])) for c, vs in self.categories.items() for v in vs]
        rows += [("center", c, None, float(v)) for c, v in self.centers.items()]
        rows += [("scale", c, None, float(v)) for c, v in self.scales.items()]
        rows = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "pos INT, kind STRING, column STRING, level STRING, value DOUBLE")

    @staticmethod
    def from_table(table: DataFrame) -> "Preprocessor":
        parts: dict[str, list] = {k: [] for k in ("median", "missing", "level", "center", "scale")}
        for r in table.orderBy("pos").collect():
            parts[r["kind"]].append(r)
        pairs = lambda kind: {r["column"]: r["value"] for r in parts[kind]}
        categories: dict[str, list[str]] = {}
        for r in parts["level"]:
            categories.setdefault(r["column"], []).append(r["level"])
        modes = {r["column"]: r["level"] for r in parts["level"] if r["value"] == 1.0}
        return Preprocessor(pairs("median"), [r["column"] for r in parts["missing"]], categories, modes,
                            pairs("center"), pairs("scale"))


def category_levels(df: DataFrame, columns: list[str]) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Sorted levels and the most frequent level (ties: the smallest) of each categorical column."""
    if not columns:
        return {}, {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns])
    counted = (df.select(F.explode(pairs).alias("p")).select("p.*").where("level is not null")
               .groupBy("column", "level").count().collect())
    levels = {c: sorted(r["level"] for r in counted if r["column"] == c) for c in columns}
    modes = {c: min((-r["count"], r["level"]) for r in counted if r["column"] == c)[1]
             for c in columns if levels[c]}
    return {c: v for c, v in levels.items() if v}, modes


def impute_median(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns imputed by the training median plus ``<column>_missing`` flags for
    columns that lacked values in training."""
    fitted = Preprocessor.fit(train, scale=False, numeric=columns, categorical=[])
    others = [c for c in df.columns if c not in columns]
    return fitted.transform(df, keep=others)


def zscore(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise by training mean and population deviation, constants are only centred."""
    fitted = Preprocessor.fit(train, scale=True, numeric=columns, categorical=[])
    return fitted.transform(df, keep=[c for c in df.columns if c not in columns])


def impute_mode(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    _, modes = category_levels(train, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items()})


def one_hot(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """One 0/1 column per training level; a level never seen in training is all zeros."""
    fitted = Preprocessor.fit(train, scale=False, numeric=[], categorical=columns)
    return fitted.transform(df, keep=[c for c in df.columns if c not in columns])
