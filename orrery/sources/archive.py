"""Archive of models, statistics, events and status as Parquet tables; later rows replace earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TABLES = {
    "models": "mnemonic string, algorithm string, state string, ref_time double, period double, sigma double, tpc double, np int, params array<double>, pattern_times array<double>, written_at double",
    "cycle_stats": "mnemonic string, state string, time double, max double, min double, mean double, sigma double, written_at double",
    "coefficients": "mnemonic string, state string, time double, offset double, scale double, written_at double",
    "events": "timetag bigint, id string, state string, period double, value double, written_at double",
    "status": "mnemonic string, state string, time double, code double, tpc double, oc_value double, derivative double, sigma double, max double, min double, mean double, stat_sigma double, written_at double",
    "outliers": "mnemonic string, state string, time double, value double, limit double, diff double, written_at double",
}


def latest(rows: DataFrame, keys: list[str], order: str = "written_at") -> DataFrame:
    """Of the rows with one key the last written."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def in_range(rows: DataFrame, time: str, start: float, end: float) -> DataFrame:
    """Rows of a time range, both ends inclusive."""
    return rows.where(F.col(time).between(start, end))


def latest_model(models: DataFrame, start: float, end: float) -> DataFrame:
    """Of each channel and state the model with the last reference time in range."""
    rest = [c for c in models.columns if c not in ("mnemonic", "state")]
    best = F.max_by(F.struct(*rest), "ref_time").alias("_m")
    return in_range(models, "ref_time", start, end).groupBy("mnemonic", "state").agg(best).select("mnemonic", "state", "_m.*")


def new_events(events: DataFrame, history: DataFrame, cutoff: float, least: float | None = 0.5) -> DataFrame:
    """Events after the cutoff (above `least`, where given) that the history lacks."""
    kept = events.where(F.col("event_start") > cutoff)
    if least is not None:
        kept = kept.where(F.col("event_value") > least)
    rows = kept.select((F.col("event_start") * 1000).cast("long").alias("timetag"), F.col("name").alias("id"), F.col("event_state").alias("state"), (F.col("event_end") - F.col("event_start")).alias("period"), F.col("event_value").alias("value"))
    return rows.join(history.select("timetag", "id"), ["timetag", "id"], "left_anti").select(*rows.columns)


def model_points(models: DataFrame) -> DataFrame:
    """Sigma, parameters and later pattern times of a model, by index."""
    vector = F.concat(F.array("sigma"), "params", F.slice("pattern_times", 2, F.greatest(F.size("pattern_times") - 1, F.lit(0))))
    return models.select("mnemonic", "state", F.posexplode(vector).alias("index", "value"))


def event_code(name: Column, value: Column, period: Column, state: Column) -> Column:
    """Event as text."""
    return F.concat_ws("|", name, value.cast("string"), period.cast("string"), state)


def decode_events(rows: DataFrame, code: str, registry: DataFrame) -> DataFrame:
    """Events from text; fewer than three parts or an unknown channel give no row."""
    part = F.split(F.col(code), r"\|")
    found = rows.withColumn("_p", part).where(F.size("_p") >= 3)
    out = found.select(F.col("_p")[0].alias("name"), F.col("_p")[1].cast("double").alias("event_value"), F.col("_p")[2].cast("double").alias("period"), F.coalesce(F.try_element_at("_p", F.lit(4)), F.lit("default")).alias("state"))
    return out.join(registry.select("name").distinct(), "name", "left_semi")


class Archive:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def append(self, table: str, rows: DataFrame, written_at: float) -> None:
        """One append; columns that rows lack are null."""
        have = set(rows.columns)
        fields = [f.strip().split(" ", 1) for f in TABLES[table].split(", ")]
        cols = [F.lit(written_at).cast(k).alias(c) if c == "written_at" else (F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in fields]
        rows.select(*cols).write.mode("append").parquet(f"{self.folder}/{table}")

    def models(self, start: float, end: float) -> DataFrame:
        return latest_model(latest(self.read("models"), ["mnemonic", "state", "ref_time"]), start, end)
