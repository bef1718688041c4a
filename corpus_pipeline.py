"""From raw documents to shards of a training mix: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.decontaminate import without_leaks
from tracemill.llm.language import UNKNOWN, identify, train
from tracemill.llm.mixing import mix
from tracemill.llm.ngram_join import ngram_classes
from tracemill.llm.shared import Scratch, keep_ids, short_batches
from tracemill.llm.sharding import assign

#: How far from chance to certainty the mean probability of a document's likeliest language must lie, at least.
SURE = 1 / 6
#: Bytes of an Arrow batch, just under a run of textarrays: all stages share the executors, whose buffers stay as large as the largest batch made them.
BATCH = 15 << 16
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def least_score(languages: int) -> float:
    """The score below which the network can't tell the language: chance, one over their number, and SURE of the way to 1. One language is always sure."""
    return 1 / languages + SURE * (1 - 1 / languages) if languages > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter in it, or a likeliest language that is hardly likelier than chance (least_score()). A null lang becomes the predicted one.

    Rows are judged one by one, by their text: a null, empty or blank text goes, doc_id, null or repeated, has no part in
    it. Where there is nothing to learn from (no row with lang and text that isn't held out) only those without a letter go.
    """
    short_batches(spark, BATCH)
    model = train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(DOCUMENT)
    found = identify(docs, carry=("text", "lang", "source", "n_chars"), model=model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(len(model[0])))).withColumn("lang", F.coalesce("lang", "lang_pred")).select(DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by a Jaccard similarity of 0.8 on five-word shingles, in one row.

    Rows of one doc_id are one document: the first of them in order of its columns stays. Documents without words link
    with nothing and stay; so do rows without doc_id, each by itself. Only rows whose doc_id goes or comes more than
    once, and a few that the filter mistakes for these, are moved.
    """
    short_batches(spark, BATCH)
    classes = ngram_classes(docs, shingle=5, percent=80).where("doc_id is not null")
    per = classes.groupBy("doc_id").agg(F.min("component_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    judged = Scratch(spark).save(per.where("doc_id <> _first or _rows > 1"), "judged")
    plain = docs.select(DOCUMENT)
    met = keep_ids(plain, judged).join(judged, "doc_id", "left").where("_first is null or _first = doc_id")
    others = [c for c in DOCUMENT if c != "doc_id"]
    once = met.where("_rows > 1").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_row")).select("doc_id", "_row.*")
    single = met.where("_rows is null or _rows = 1")
    return keep_ids(plain, judged, others=True).unionByName(single.select(DOCUMENT)).unionByName(once.select(DOCUMENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds an item of the benchmark, changed words or not.

    Each row is judged by its text alone, where it is read: doc_id, null or repeated, has no part in it, and null or
    empty texts stay. An empty benchmark drops nothing.
    """
    short_batches(spark, BATCH)
    return without_leaks(docs.select(DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number of each row in _row, written, so that all who read it see the same."""
    return Scratch(spark).save(docs.select(*DOCUMENT, F.monotonically_increasing_id().alias("_row")), "numbered")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes its words: whole passes, and once more if the last pass takes half of it or more.

    Rows count one by one, whether doc_id is null or repeated; those without words go. Fully equal rows are
    interchangeable. A null source is a source of its own.
    """
    rows = numbered(spark, docs)
    taken = mix(rows, carry=("_row",)).where("size > 0").select("_row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies"))
    repeated = rows.join(taken.where("copies > 0"), "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(DOCUMENT)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, copies included: rows of one doc_id share a shard and have slots of their own; no doc_id is a key too."""
    return assign(docs, n_shards=16)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Two stages are trained models or latent retrieval, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
