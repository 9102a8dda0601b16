"""Data quality: column profiles, drift between profiles, label leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DriftLimits:
    missing_fraction: float = 0.05
    mean: float = 0.25
    std_ratio: float = 0.5
    unique_ratio: float = 0.3


def _is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Long profile (column, metric, value): rows, missing fraction, distinct count, and mean/std/min/max of numbers.

    Exact distinct counts run one column at a time as group-bys, so no row is expanded once per column and no hot value
    is gathered anywhere; ``approximate`` puts them into the one scan.
    """
    aggregates, names = [F.count(F.lit(1)).cast("double").alias("v0")], [("*", "row_count")]

    def add(column: str, metric: str, expression) -> None:
        aggregates.append(F.coalesce(expression.cast("double"), F.lit(0.0)).alias(f"v{len(names)}"))
        names.append((column, metric))

    for field in df.schema.fields:
        c = F.col(field.name)
        add(field.name, "missing_fraction", F.avg(c.isNull().cast("double")))
        if approximate:
            add(field.name, "unique_count", F.approx_count_distinct(c))
        if _is_number(field.dataType):
            add(field.name, "mean", F.avg(c))
            add(field.name, "std", F.stddev_pop(c))
            add(field.name, "min", F.min(c))
            add(field.name, "max", F.max(c))
    wide = df.agg(*aggregates)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, (c, m) in enumerate(names)])
    result = wide.select(F.inline(entries))
    if not approximate:
        for field in df.schema.fields:
            values = df.select(F.col(field.name).alias("x")).filter(F.col("x").isNotNull()).groupBy("x").agg(F.lit(1))
            result = result.unionByName(
                values.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(field.name).alias("column"), F.lit("unique_count").alias("metric"), "value")
            )
    return result


def compare_profiles(baseline: DataFrame, current: DataFrame, limits: DriftLimits = DriftLimits()) -> DataFrame:
    """Violations (column, metric, baseline, current, threshold) over the columns both profiles have. All limits strict."""
    both = baseline.select("column", "metric", F.col("value").alias("b")).join(
        current.select("column", "metric", F.col("value").alias("c")), ["column", "metric"]
    )
    change = F.abs(F.col("c") - F.col("b"))
    relative = F.when(F.col("b") > 0.0, change / F.col("b"))
    rules = [
        ("missing_fraction", "missing_fraction", change, limits.missing_fraction),
        ("unique_count", "unique_count_ratio", relative, limits.unique_ratio),
        ("mean", "mean_delta", change, limits.mean),
        ("std", "std_ratio", relative, limits.std_ratio),
    ]
    found = F.array(
        *[
            F.when((F.col("metric") == source) & (value > limit), F.struct(F.lit(name).alias("name"), F.lit(limit).alias("threshold")))
            for source, name, value, limit in rules
        ]
    )
    hits = both.withColumn("hit", F.explode(F.filter(found, lambda h: h.isNotNull())))
    return hits.select("column", F.col("hit.name").alias("metric"), F.col("b").alias("baseline"), F.col("c").alias("current"), F.col("hit.threshold").alias("threshold"))


def correlation_leakage(df: DataFrame, label: str = "label", threshold: float = 0.95, min_rows: int = 3) -> DataFrame:
    """Absolute Pearson correlation of each numeric column with the label; one scan. Constant columns are left out."""
    columns = [f.name for f in df.schema.fields if _is_number(f.dataType) and f.name != label]
    if label not in df.columns or not columns:
        return df.sparkSession.createDataFrame([], "column string, correlation double, leaked boolean")
    pairs = []
    for name in columns:
        x, y = F.col(name).cast("double"), F.col(label).cast("double")
        both = x.isNotNull() & y.isNotNull()
        usable = (F.count(F.when(both, 1)) >= min_rows) & (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))
        pairs.append(F.when(usable, F.abs(F.corr(x, y))).alias(name))
    wide = df.agg(*pairs)
    entries = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("correlation")) for n in columns])
    long = wide.select(F.inline(entries)).filter(F.col("correlation").isNotNull())
    return long.withColumn("leaked", F.col("correlation") >= threshold)


def forest_leakage(df: DataFrame, label: str = "label", threshold: float = 0.8, trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Columns whose random-forest importance exceeds the threshold; empty when the label has fewer than two classes."""
    columns = [f.name for f in df.schema.fields if _is_number(f.dataType) and f.name != label]
    spark = df.sparkSession
    frame = df.select(F.col(label).cast("int").alias("__y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).fillna(0, ["__y"])
    low, high = frame.agg(F.min("__y"), F.max("__y")).first()
    schema = "column string, importance double, leaked boolean"
    if not columns or low is None or low == high:
        return spark.createDataFrame([], schema)
    frame = frame.withColumn("__y", F.col("__y") - F.lit(low))
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(frame)
    model = RandomForestClassifier(featuresCol="features", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(c, float(v), bool(v > threshold)) for c, v in zip(columns, values)], schema)
