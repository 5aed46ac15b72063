"""Mixing sources to target weights by Sainte-Laguë apportionment.

Weights share the corpus out among the sources; a target stops at `repeats` times its source's size and
the excess goes to the others by weight. The targets are then paid out in blocks of `block_words` words:
block quotas go to sources by the highest quotients target / (2 s - 1), and inside a source to its shards
by the highest quotients size / (2 s - 1). A shard's documents in a seeded order are one sequence of blocks;
it takes whole passes of them first, then the blocks from its beginning until the quota ends, the last document in part.

The quotients need no ranking of all blocks. A share can differ from its exact quota by at most
share * m / 2 + 1 seats for m parties, so only that band of quotients is ranked: about four rows a party.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id is ordinary.
Repeated rows are documents of their own; ties of ids go by size. An empty table gives an empty result. A long text is
one document whose blocks may be taken in part. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, staged


def _apportion(parties: DataFrame, keys: list[str], votes: str, seats: str, order: list) -> DataFrame:
    """Adds `quota`: the seats of each party of its group (keys; none: one group) by Sainte-Laguë."""
    group = Window.partitionBy(*keys)
    exact = F.col("_v") * F.col("_n") / F.expr("nullif(_all, 0)")
    slack = F.col("_v") / F.expr("nullif(_all, 0)") * F.col("_m") / 2 + 1
    band = (
        parties.withColumn("_v", F.col(votes).cast("double"))
        .withColumn("_n", F.col(seats).cast("double"))
        .withColumns({"_all": F.sum("_v").over(group), "_m": F.count(F.lit(1)).over(group), "_at": F.row_number().over(group.orderBy(*order))})
        .withColumn("_base", F.greatest(F.lit(0), F.coalesce(F.floor(exact - slack), F.lit(0))).cast("long"))
        .withColumn("_top", F.greatest(F.col("_base"), F.coalesce(F.ceil(exact + slack), F.lit(0))).cast("long"))
        .withColumn("_left", F.col("_n").cast("long") - F.sum("_base").over(group))
    )
    ranked = (
        band.where("_top > _base")
        .withColumn("_s", F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))))
        .withColumn("_r", F.row_number().over(group.orderBy((F.col("_v") / (2 * F.col("_s") - 1)).desc(), "_at", "_s")))
        .where("_r <= _left")
    )
    won = ranked.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_won"))
    same = F.lit(True)
    for k in [*keys, "_at"]:
        same &= F.col(f"b.{k}").eqNullSafe(F.col(f"w.{k}"))
    out = band.alias("b").join(won.alias("w"), same, "left")
    return out.select(*(F.col(f"b.{c}") for c in parties.columns), (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target; the sources are few, so one task orders them."""
    every = Window.partitionBy()
    below = Window.orderBy("_ratio", "_at").rowsBetween(Window.unboundedPreceding, -1)
    kinds = F.array(*map(F.lit, weights))
    return (
        sizes.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", kinds[((F.col("_at") - 1) % len(weights)).cast("int")])
        .withColumn("_ratio", repeats * F.col("source_size") / F.col("weight"))
        .withColumns({"_all": F.sum("source_size").over(every), "_w": F.sum("weight").over(every)})
        .withColumns({"_capped": F.coalesce(F.sum(repeats * F.col("source_size")).over(below), F.lit(0)), "_gone": F.coalesce(F.sum("weight").over(below), F.lit(0))})
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_w") - F.col("_gone")))
        .withColumn("_lambda", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_at", "_level"))).over(every)["_level"])
        .withColumn("target", F.least((repeats * F.col("source_size")).cast("double"), F.col("weight") * F.col("_lambda")))
        .select("source", "source_size", "weight", "target")
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block_words: int = 16, shard_words: int = 500_000, seed: str = "mix") -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken (words, repeats counted)."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, repeats=repeats)
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words))
    quotas = staged(_apportion(seats, [], "target", "_seats", [F.col("source").asc_nulls_last()]), "sources")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    q = quotas.select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("_blocks"))
    dealt = (
        rows.join(q, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_key", key)
        .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        .withColumn("shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("_blocks").alias("_blocks"))
    paid = _apportion(shards, ["source"], "shard_size", "_blocks", [F.col("shard")])
    paid = paid.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", F.least(F.col("quota") * block_words, repeats * F.col("shard_size")).alias("words"))
    before = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("_key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    passes = F.coalesce(F.floor(F.col("words") / F.expr("nullif(shard_size, 0)")), F.lit(0)).cast("long")
    return (
        dealt.join(paid, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
        .withColumns({"_before": before, "_passes": passes})
        .withColumn("taken", F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("_passes") * F.col("shard_size") - F.col("_before"))))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )
