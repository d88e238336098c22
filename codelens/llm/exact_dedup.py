"""Exact de-duplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so (after white space that follows
one of ``BREAK_AFTER``, at least MIN_CHUNK and at most MAX_CHUNK characters
on), so equal texts have equal chunks. A chunk's identifier is its 64-bit hash
together with its rank among the distinct contents that have this hash; the
distinct chunks move once to verify that, and in practice every rank is 0.
Two texts are equal exactly if their ordered lists of identifiers are: the
rest of the work moves these recipes, not the texts.

Defined results: null text counts as empty (an empty recipe); rows that
repeat both doc_id and text are copies in one group and share their verdict
(``dedup`` returns one of them); groups of any size are pre-aggregated, and
the join that hands the verdict back is a plain equi-join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.llm.common import cut, keep_where, table, text_or_empty

MIN_CHUNK, MAX_CHUNK = 512, 4096
BREAK_AFTER = "[adglmnry.,;:!?]"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<={BREAK_AFTER}\s)|\z)|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """The text cut into content-defined chunks; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_hashes(text: Column) -> Column:
    return F.transform(chunks(text), chunk_hash)


def distinct_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, chunk) of the distinct chunks: each content moves once."""
    pieces = docs.select(F.explode(chunks(text_or_empty(text))).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    return pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one")).select("h", "chunk")


def colliding_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Hashes that stand for more than one chunk content; normally none."""
    return distinct_chunks(docs, text).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, recipe, text_sha256): the ordered list of verified chunk identifiers of each row."""
    body = text_or_empty(text)
    rows = docs.select(F.col(key), F.sha2(body.cast("binary"), 256).alias("text_sha256"), chunk_hashes(body).alias("recipe"))
    collisions = cut(colliding_hashes(docs, text))
    if collisions.isEmpty():
        return rows
    # a collision of 64-bit hashes in the corpus: append (place, rank) of the chunks whose rank is above 0
    rank = F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1
    later = distinct_chunks(docs, text).join(collisions, "h", "left_semi").withColumn("rank", rank).filter("rank > 0")
    found = (
        docs.select(F.col(key), F.sha2(body.cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(body)).alias("pos", "chunk"))
        .withColumn("h", chunk_hash(F.col("chunk"))).join(later, ["h", "chunk"])
        .groupBy(key, "text_sha256").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank")))).alias("_ranks"))
    )
    same = [F.col(f"r.{key}").eqNullSafe(F.col(f"f.{key}")), F.col("r.text_sha256") == F.col("f.text_sha256")]
    flat = F.flatten(F.transform(F.coalesce("_ranks", F.array().cast("array<struct<pos:bigint,rank:bigint>>")), lambda x: F.array(x["pos"], x["rank"])))
    return rows.alias("r").join(found.alias("f"), same[0] & same[1], "left").select(
        f"r.{key}", "r.text_sha256", F.concat("recipe", F.array(F.lit(-1).cast("long")), flat).alias("recipe"))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row: of equal texts the largest key stays."""
    rows = cut(recipes(docs, key, text))
    groups = rows.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns; one row where doc_id and text repeat."""
    def decide(rows: DataFrame, key: str, text: str) -> DataFrame:
        kept = verdicts(rows, key, text).filter("kept").select(F.col(key).alias("key"), F.col("text_sha256").alias("sha")).distinct()
        hashed = rows.withColumn("sha256", F.sha2(text_or_empty(text).cast("binary"), 256))
        same = F.col(key).eqNullSafe(F.col("key")) & (F.col("sha256") == F.col("sha"))
        return hashed.join(kept, same, "left_semi").dropDuplicates([key, "sha256"])

    return keep_where(docs, decide, key, text)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
