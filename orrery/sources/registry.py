"""Registry of channels: JSON files of subsystems, or any table of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_STATE = T.StructType([T.StructField(x, T.StringType()) for x in ("name", "algorithm", "flag", "dim_pointer", "pad_factor")])
_MODEL = T.StructType([T.StructField("name", T.StringType()), T.StructField("dim", T.ArrayType(T.StringType())), T.StructField("state", T.ArrayType(_STATE)), T.StructField("attribute", T.ArrayType(T.StringType())), T.StructField("option", T.StringType()), T.StructField("stat", T.StringType()), T.StructField("np", T.StringType())])
_CHANNEL = T.StructType([T.StructField("name", T.StringType()), T.StructField("frequency", T.StringType()), T.StructField("warning_limit", T.StringType()), T.StructField("error_limit", T.StringType()), T.StructField("depends", T.StringType()), T.StructField("attributes", T.ArrayType(T.StringType())), T.StructField("sml", _MODEL), T.StructField("lml", T.ArrayType(_MODEL))])
SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("satid", T.StringType()), T.StructField("mnemonics", T.ArrayType(_CHANNEL))])


def packed_map(items: Column) -> Column:
    """Array of 'key|value' as a map; a key without value maps to the empty string."""
    pairs = F.transform(items, lambda x: F.struct(F.element_at(F.split(x, r"\|"), 1).alias("k"), F.array_join(F.slice(F.split(x, r"\|"), 2, 1000), "|").alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a channel from the JSON files of a folder; scalars may be text or numbers."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = files.select(F.col("name").alias("subsystem"), "satid", F.explode("mnemonics").alias("m")).select("subsystem", "satid", "m.*")
    limits = {c: F.col(c).cast("double") for c in ("frequency", "warning_limit", "error_limit")}
    return rows.withColumns(limits).withColumn("attribute", packed_map(F.coalesce("attributes", F.array().cast("array<string>"))))


def channels(registry: DataFrame) -> DataFrame:
    """Each channel with itself and what it depends on, in order."""
    names = F.concat(F.array("name"), F.filter(F.split(F.coalesce("depends", F.lit("")), r"\|"), lambda x: x != ""))
    return registry.select("name", F.posexplode(names).alias("place", "channel"))


def lookup(rows: DataFrame, registry: DataFrame, columns: list[str]) -> DataFrame:
    """Registry columns by channel name."""
    return rows.join(registry.select(F.col("name").alias("mnemonic"), *columns), "mnemonic")
