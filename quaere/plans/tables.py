"""The library's inputs, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import sentence_texts
from ..sources.readers import describe


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer parts than there are cores, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, title, doc_ord``."""
    return read(spark, sf_dir, "documents").select("doc_id", "text", T.title(F.col("text"), F.lit("document.txt")).alias("title"), F.col("doc_id").alias("doc_ord"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that are named after their source, in order of their ids."""
    raw = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "text", "source", F.concat("source", F.lit(".txt")).alias("filename"))
    return describe(raw)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ``query_id, text``."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where nations lie and suppliers sit, as facts."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    supplier = read(spark, sf_dir, "supplier")
    lies = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("subject"), F.lit("located_in").alias("relation"), F.col("r_name").alias("object"))
    sits = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select((F.col("s_suppkey") + 1000).alias("ord"), F.col("s_name").alias("subject"), F.lit("based_in").alias("relation"), F.col("n_name").alias("object"))
    return lies.unionByName(sits).withColumn("doc_id", F.lower("relation"))


#: relation, label, cues: what a question about each relation says.
CUES = [("located_in", "is located in", ["located", "where is", "which region"]), ("based_in", "is based in", ["based", "where is the seat of", "which country"])]
#: Documents that a bounded collection takes.
CAP = 150
#: Titles that a reply lists; all documents are counted and searched.
LISTED = 20
ALIASES = [("the first nation", "NATION_0"), ("the last nation", "NATION_24")]


def cues(spark: SparkSession) -> DataFrame:
    rows = [(r, relation, label, c, cue) for r, (relation, label, found) in enumerate(CUES) for c, cue in enumerate(found)]
    return spark.createDataFrame(rows, "rel_ord int, relation string, label string, cue_ord int, cue string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, c) for k, (a, c) in enumerate(ALIASES)], "ord int, alias string, canonical string")


def fact_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each fact, and one by each alias: ``query_id, text``."""
    own = facts(spark, sf_dir).select(F.col("ord").alias("query_id"), F.when(F.col("relation") == "located_in", F.concat(F.lit("Where is "), "subject", F.lit(" located?"))).otherwise(F.concat(F.lit("Which country is "), "subject", F.lit(" based in?"))).alias("text"))
    other = aliases(spark).select((F.col("ord") - 10).cast("bigint").alias("query_id"), F.concat(F.lit("Which region has "), "alias", F.lit("?")).alias("text"))
    return own.unionByName(other)


#: Follow-ups that come after each conversation's own turns: place, and text before and after a nation's name.
FOLLOW_UPS = [(1000, "Where is ", " located?"), (1001, "and where?", None), (1002, "Who lives in it?", None), (1003, "thanks", None), (1004, "Which country is Supplier near ", "?"), (1005, "Which region is it?", None)]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, text``: what users say, and some follow-ups."""
    said = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    ids = said.select("conv_id").distinct()
    name = F.concat(F.lit("NATION_"), F.pmod("conv_id", F.lit(25)).cast("string"))
    more = [ids.select("conv_id", F.lit(turn).cast("bigint").alias("turn"), (F.lit(head) if tail is None else F.concat(F.lit(head), name, F.lit(tail))).alias("text")) for turn, head, tail in FOLLOW_UPS]
    for df in more:
        said = said.unionByName(df)
    return said


#: What is asked about each benchmark item: a name, a year, a number, anything.
ITEM_QUESTIONS = ["Who wrote {}?", "When was {} made?", "How many {} are there?", "Tell me of {}"]


def item_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of several kinds about each whole benchmark item: ``query_id, text``."""
    items = read(spark, sf_dir, "benchmark")
    made = [F.struct((F.col("item_id") * len(ITEM_QUESTIONS) + k).alias("query_id"), F.concat(*(x for part in zip(map(F.lit, q.split("{}")), [F.col("text"), F.lit("")]) for x in part)).alias("text")) for k, q in enumerate(ITEM_QUESTIONS)]
    return items.select(F.inline(F.array(*made)))


#: Questions of every kind, asked in turn about the sentences of each document.
KINDS = ["How many {} are there?", "Who wrote {}?", "When was {} made?", "Where is {}?", "Which company owns {}?", "What is a {}?", "Why does {} matter?", "Which method finds {}?", "Tell me of {}"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each sentence of each document: ``doc_id, sid, text``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select("doc_id", F.posexplode(sentence_texts(F.col("text"))).alias("sid", "s"))
    asked = [F.concat(F.lit(q.split("{}")[0]), F.col("s"), F.lit(q.split("{}")[1])) for q in KINDS]
    return said.select("doc_id", "sid", F.get(F.array(*asked), F.col("sid") % len(KINDS)).alias("text"))
