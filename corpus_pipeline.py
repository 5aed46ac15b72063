"""The corpus pipeline: toxicity, line dedup, near-duplicate join, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() writes each stage's rows
as Parquet to the shared folder and gives them to the next.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from orrery.llm import common, line_dedup, mixing, ngram_join, packing, queries, toxicity
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_WORDS = re.compile(common.WORD)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the learned toxicity score, so no stage after it either.
ORACLE_SQL = None


def _columns(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, short ones too; a document that loses all its lines goes with them."""
    kept = line_dedup.drop_recurring_lines(docs.select(*COLUMNS), long_docs=None)
    return _columns(kept.where("n_dropped = 0 or n_dropped < n_lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, the least by id and text; then long lines of two or more of the rows that stay go.

    The lines come after the copies: a copy that had lost its shared lines before would no longer be like its
    original, and its other lines would stay. A row that loses all its lines goes.
    """
    docs = docs.select(*COLUMNS)
    found = common.staged(ngram_join.jaccard_components(docs.select("doc_id", "text"), with_first=True, with_links=False).where("first is not null").select("doc_id", "t", "first"), "found")
    mine = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    copies = common.staged(found.where(~mine).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct(), "copies")
    again = common.staged(found.where(mine).groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).count().where("count > 1").select("_id", "_t"), "again")
    keyed = line_dedup.line_keys(docs, kinds=("long",)).where("size(flatten(_keys)) > 0").alias("l").join(copies.alias("c"), F.expr("l._id <=> c._id and l._t = c._t"), "left_anti")
    rows = keyed.select(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), "_t").alias("_id"), "_t", "_keys")
    repeated = not again.isEmpty()
    lines = line_dedup.recurring_lines(rows.dropDuplicates(["_id"]) if repeated else rows, {"long": 2}).select(F.col("_id.id").alias("_id"), "_t", "_gone")
    verdict = copies.select("_id", "_t", F.lit(True).alias("_copy"), F.lit(None).cast("array<int>").alias("_gone")).unionByName(lines.select("_id", "_t", F.lit(False).alias("_copy"), "_gone"))
    both = docs.withColumn("_rt", F.xxhash64("text")).join(verdict, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rt") == F.col("_t")), "left").where("_copy is null or not _copy").drop("_id", "_t")
    split = F.split("text", "\n", -1)
    kept = both.where(F.col("_gone").isNull() | (F.size("_gone") < F.size(split)))
    if repeated:
        marked = common.staged(kept, "kept").join(again.withColumn("_again", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rt") == F.col("_t")), "left")
        kept = marked.where("_again is null").unionByName(marked.where("_again").dropDuplicates(["doc_id", "_rt"]))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(line_dedup.without(split, F.col("_gone")))
    return _columns(kept.withColumn("text", text))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts up to the end of word number _rest, the last column."""
    for batch in batches:
        texts = []
        for text, n in zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            texts.append(text[: next(itertools.islice(_WORDS.finditer(text), n - 1, n)).end()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:-1]], list(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; what is left of its words comes as one shortened copy."""
    taken = common.staged(mixing.mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "taken"), "taken")
    rows = docs.select(*COLUMNS)
    if taken.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.join(taken.select(F.col("doc_id").alias("_id"), "size", "taken").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    else:
        # rows of one id: those of equal source and size are told apart by an ordinal
        same = Window.partitionBy("doc_id", "source", "size")
        sized = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long"))
        sized = sized.withColumn("_at", F.row_number().over(same.orderBy(F.xxhash64("text"), "lang", "n_chars")))
        paid = taken.withColumn("_n", F.row_number().over(same.orderBy(F.col("taken").desc()))).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_n", "taken").hint("merge")
        rows = sized.join(paid, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_at") == F.col("_n")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    cut = rows.withColumn("_whole", whole).withColumn("_rest", rest)
    full = cut.where("_whole > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_whole"))))
    part = cut.where("_rest > 0").select(*COLUMNS, "_rest").mapInArrow(_first_words, cut.select(*COLUMNS).schema)
    return _columns(full.select(*COLUMNS).unionByName(part.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("source_mix", mix), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
