"""Text collections, fact bases and gold questions as DataFrames, and writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.staging import written
from ..params import DEFAULTS, Params


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text, with the replacement character for what isn't valid."""
    return F.make_valid_utf8(content.cast("string"))


def read_directory(spark: SparkSession, path: str, *, source: str = "bundled", params: Params = DEFAULTS) -> DataFrame:
    """``path, filename, raw, source, doc_ord`` of the files with an allowed suffix (of any case), in order of their paths."""
    endings = "|".join(s.lstrip(".") for s in params.suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.regexp_like(F.lower("path"), F.lit(rf"\.(?:{endings})$")))
    named = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), decoded(F.col("content")).alias("raw"), F.lit(source).alias("source"))
    return with_order(named, "path")


def with_order(df: DataFrame, key: str) -> DataFrame:
    """``doc_ord``: the place of each row in the order of a key of its own.

    Keys alone are dealt out in ranges and numbered within each, after all those of the ranges before.
    """
    ranged = written(df.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    order = ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_nth") - 1).alias("doc_ord"))
    return df.join(order, key)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as they arrive: a stream of ``path, filename, raw, source``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), decoded(F.col("content")).alias("raw"), F.lit("upload").alias("source"))


FACTS_SCHEMA = """
relations array<struct<name:string,label:string,answer_type:string,cues:array<string>>>,
aliases array<struct<alias:string,canonical:string>>,
facts array<struct<s:string,r:string,o:string,doc:string>>
"""


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, cues and aliases of a JSON fact base whose lists keep their order."""
    base = spark.read.schema(FACTS_SCHEMA).option("multiLine", "true").json(path)
    facts = base.select(F.posexplode("facts").alias("ord", "f")).select("ord", F.col("f.s").alias("subject"), F.col("f.r").alias("relation"), F.col("f.o").alias("object"), F.coalesce("f.doc", F.lit("")).alias("doc_id"))
    relations = base.select(F.posexplode("relations").alias("rel_ord", "r"))
    cues = relations.select("rel_ord", F.col("r.name").alias("relation"), F.col("r.label").alias("label"), F.posexplode("r.cues").alias("cue_ord", "cue"))
    aliases = base.select(F.posexplode("aliases").alias("ord", "a")).select("ord", F.lower("a.alias").alias("alias"), F.col("a.canonical").alias("canonical"))
    return facts, cues, aliases


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``qid, q, a, doc, type`` of a JSON object with a list of pairs; no answer means that the question must be refused."""
    base = spark.read.schema("pairs array<struct<q:string,a:string,doc:string,type:string>>").option("multiLine", "true").json(path)
    return base.select(F.posexplode("pairs").alias("qid", "p")).select("qid", "p.*")


def download_name(filename: Column, doc_id: Column) -> Column:
    return F.when(F.coalesce(filename, F.lit("")) != "", filename).otherwise(F.concat(doc_id, F.lit(".txt")))


def write_texts(docs: DataFrame, path: str) -> None:
    """Each document's text in a folder of its own name."""
    docs.select(download_name(F.col("filename"), F.col("doc_id")).alias("file"), F.col("text").alias("value")).write.partitionBy("file").text(path)


def as_documents(raw: DataFrame, *, params: Params = DEFAULTS) -> DataFrame:
    """Files as documents: normalised text, title, checksum, sizes, and why a document is refused (null if it isn't)."""
    made = raw.withColumn("text", T.normalise(F.col("raw"))).drop("raw")
    return describe(made, params=params)


def describe(docs: DataFrame, *, params: Params = DEFAULTS) -> DataFrame:
    """``slug, title, checksum, char_count, word_count, reject_reason`` for documents with ``filename`` and ``text``."""
    n = F.length("text")
    return docs.withColumns({
        "slug": T.slug(F.col("filename")),
        "title": T.title(F.col("text"), F.col("filename")),
        "checksum": F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16),
        "char_count": n,
        "word_count": F.size(T.tokens(F.col("text"))),
        "reject_reason": F.when(n < params.min_doc_chars, "too short").when(n > params.max_doc_chars, "too long"),
    })
