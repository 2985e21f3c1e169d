"""A bounded, de-duplicated, ordered collection of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN  # noqa: F401  (the token pattern that word_count follows)
from ..params import DEFAULTS, Params


def admit(docs: DataFrame, *, params: Params = DEFAULTS) -> DataFrame:
    """All documents with ``doc_id`` and ``reject_reason``: too short, too long, duplicate, or over the cap.

    Of equal texts the first by ``doc_ord`` stays.  Without a cap nothing needs a global order; with one, admitted
    documents are numbered, and those beyond it are refused.  A name that is taken gets the next free number.
    """
    fit = docs.where("reject_reason IS NULL")
    first = fit.groupBy("checksum").agg(F.min("doc_ord").alias("_first"))
    marked = docs.join(first, "checksum", "left")
    reason = F.coalesce("reject_reason", F.when(F.col("doc_ord") > F.col("_first"), F.lit("duplicate")))
    marked = marked.withColumn("reject_reason", reason).drop("_first")
    if params.max_docs is not None:
        kept = marked.where("reject_reason IS NULL").orderBy("doc_ord").limit(params.max_docs).select(F.col("doc_ord").alias("_kept"))
        marked = marked.join(F.broadcast(kept), F.col("doc_ord") == F.col("_kept"), "left")
        marked = marked.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & F.col("_kept").isNull(), F.lit("full")).otherwise(F.col("reject_reason"))).drop("_kept")
    return with_ids(marked)


def with_ids(docs: DataFrame) -> DataFrame:
    """``doc_id`` of admitted documents: the slug, or the slug and a number from 2 on where it is taken.

    A numbered name that is itself some document's slug is passed over; the numbers are those that adding
    documents one by one would give, unless a numbered slug comes after the document that takes it.
    """
    admitted = docs.where("reject_reason IS NULL")
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("doc_ord"))
    numbered = admitted.select("doc_ord", "slug", nth.alias("n"))
    # names of the form slug-number that are slugs themselves push later numbers up
    taken = admitted.select("slug").distinct().withColumn("stem", F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1)).withColumn("number", F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2)).where("stem <> '' AND number NOT LIKE '0%'")
    taken = taken.groupBy("stem").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("numbers"))
    free = F.aggregate(F.coalesce("numbers", F.array().cast("array<int>")), F.col("n"), lambda a, v: F.when((v >= 2) & (v <= a), a + 1).otherwise(a))
    ids = numbered.join(taken, F.col("slug") == F.col("stem"), "left").select(F.col("doc_ord").alias("_ord"), F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", free.cast("string"))).alias("doc_id"))
    return docs.drop("doc_id").join(ids, F.col("doc_ord") == F.col("_ord"), "left").drop("_ord")


def members(docs: DataFrame) -> DataFrame:
    return docs.where("reject_reason IS NULL")


def remove(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row: a hash of all checksums, whatever their order, as a digest of the sorted list.

    A digest of one list is made in one place; `quick_fingerprint` serves where the checksums outgrow it.
    """
    return docs.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("checksum")), "|").cast("binary"), 256), 1, 16).alias("fingerprint"))


def quick_fingerprint(docs: DataFrame) -> DataFrame:
    """The same purpose in constant memory: XOR and sum of 60 bits of each checksum, whatever their order, and a count."""
    bits = F.conv(F.substring("checksum", 1, 15), 16, 10).cast("bigint")
    total = F.coalesce(F.sum(bits.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")
    return docs.agg(F.concat_ws("-", F.coalesce(F.bit_xor(bits), F.lit(0)).cast("string"), total.cast("string"), F.count("*").cast("string")).alias("fingerprint"))


def stats(docs: DataFrame, *, params: Params = DEFAULTS) -> DataFrame:
    """One row: documents, free slots, words, the upper median of words, and uploads.

    The median comes from counts per number of words, which are few, and not from a sorted list of documents.
    """
    counts = docs.groupBy("word_count").agg(F.count("*").alias("c"), F.sum((F.col("source") == "upload").cast("long")).alias("u"))
    folded = counts.agg(F.array_sort(F.collect_list(F.struct("word_count", "c"))).alias("h"), F.sum("c").alias("documents"), F.sum(F.col("word_count") * F.col("c")).alias("total_words"), F.sum("u").alias("uploaded"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("median"))
    step = lambda a, x: F.named_struct(F.lit("seen"), a["seen"] + x["c"], F.lit("median"), F.when(a["median"].isNull() & (a["seen"] + x["c"] > F.col("half")), x["word_count"]).otherwise(a["median"]))
    out = folded.withColumn("half", F.floor(F.col("documents") / 2)).withColumn("m", F.aggregate("h", start, step)["median"])
    slots = F.lit(None).cast("long") if params.max_docs is None else F.greatest(F.lit(params.max_docs) - F.coalesce("documents", F.lit(0)), F.lit(0)).cast("long")
    return out.select(F.coalesce("documents", F.lit(0)).alias("documents"), slots.alias("slots_free"), F.coalesce("total_words", F.lit(0)).alias("total_words"), F.coalesce("m", F.lit(0)).alias("median_words"), F.coalesce("uploaded", F.lit(0)).alias("uploaded"))


def rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "title", F.col("word_count").alias("words"), "source", F.col("filename").alias("file"))


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of each document of ``docs(doc_id, body)`` that holds an item of ``items(query_id, text)`` as it stands.

    An item's inner words, split at spaces, are words of every text that holds it: documents meet the items of whose longest
    inner word they have, and only then whole texts are compared.  Items of fewer than three words are compared with all.
    """
    words = F.split("text", " ")
    n = F.size(words)
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))
    marked = items.select("query_id", "text", F.when(n > 2, F.array_max(inner)["word"]).alias("word"))
    split_ = docs.select("doc_id", "body", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    held = F.contains(F.col("body"), F.col("text"))
    long = split_.join(F.broadcast(marked.where("word IS NOT NULL")), "word").where(held)
    short = docs.join(F.broadcast(marked.where("word IS NULL")), held)
    return long.select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id"))
