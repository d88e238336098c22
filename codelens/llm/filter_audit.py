"""How filters overlap: every order of applying them, from the sets of filters that documents fail.

What a filter removes depends on the filters before it, but a document behaves
alike in all orders once the set of filters it fails (its mask) is known. So
documents are counted by part and mask, which leaves at most 2 ** filters cells
for each part, and orders are walked over cells instead of documents: a cell
folds (``aggregate``) along each order of a constant array, which every task
holds, giving a struct for each of the 600 (order, step) places, weighted by the
cell's documents; the structs of a part's cells are added place by place.

The one filter that looks beyond its own document asks for an equal text at a
smaller id. Texts are compared by SHA-256; equal rows are counted where they
lie, then equal texts within a part, so a group of copies is a few rows for each
part when its smallest id is looked up.

Defined results: a null text is empty; a null part is the empty string; a null
id is never larger than another one, so such a row fails no duplicate test and
makes no other row fail it, and has no labels; rows that share id and text are
both as early as each other; of several labels of one id, one mark is enough; an
empty table has no parts and gives no rows; other columns of the input are not
looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.llm.common import table, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
SPACE = r" \t-\r"
_BLANKS = " \t\n\x0b\x0c\r"
#: Fields that the places of a part add up.
_SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks (an empty array for none)."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def own_failures(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the filters A to D that the text itself decides."""
    n = F.size(words).cast("long")
    fails = [
        n < 200,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 2,
        F.regexp_like(text, F.lit("[#$%&*|]")),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, at most 32 rows a part.

    ``labels`` has the columns ``key``, quality and toxic.
    """
    texts = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("text"))
    rows = texts.withColumn("words", split_words(F.col("text"))).select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text"), F.col("words")).alias("mask"),
    ).withColumn("deal", F.when(F.col("id").isNull(), F.hash("digest")).otherwise(0))  # rows without an id join nothing: spread them
    marks = (
        labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .withColumn("deal", F.lit(0))
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    marked = rows.join(marks, ["id", "deal"], "left").select("id", "deal", "digest", "part", "mask", flag("good"), flag("toxic"))
    alike = marked.groupBy("id", "deal", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = alike.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.id").over(Window.partitionBy("digest"))  # at most four rows for each part
    early = groups.withColumn("first", first).withColumn(
        "early", F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    repeat = 1 << FILTERS.index("E")
    cells = early.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("early").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("early")).alias("n")))).alias("cell")).where("cell.n > 0")
    n = F.col("cell.n")
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def _orders() -> Column:
    """All orders as one constant array of arrays of mask bits."""
    return F.expr("array(" + ", ".join(f"array({', '.join(str(1 << FILTERS.index(f)) for f in o)})" for o in ORDERS) + ")")


def _walk(order: Column, cell: dict[str, Column]) -> Column:
    """The five places of one order: a fold that remembers whether the cell is still there before each step."""
    none = F.lit(0).cast("long")

    def place(alive: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        gone = alive & fails
        return F.struct(
            bit.alias("bit"),
            F.when(alive & ~fails, cell["n"]).otherwise(none).alias("kept"),
            F.when(gone, cell["n"]).otherwise(none).alias("removed"),
            F.when(~alive & fails, cell["n"]).otherwise(none).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(none).alias("unique_fails"),
            F.when(gone, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(gone, cell["toxic"]).otherwise(none).alias("toxic_lost"),
        )

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<{_PLACE_TYPE}>").alias("places"))
    step = lambda state, bit: F.struct(
        (state["alive"] & (cell["mask"].bitwiseAND(bit) == 0)).alias("alive"),
        F.concat(state["places"], F.array(place(state["alive"], bit))).alias("places"))
    return F.aggregate(order, start, step, lambda state: state["places"])


_PLACE_TYPE = "struct<bit:int," + ",".join(f"{c}:bigint" for c in _SUMS) + ">"


def interactions(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts ..., shapley) for all orders, from (part, mask, n, good, toxic) with n above 0."""
    cell = {c: F.col(c) for c in ("mask", "n", "good", "toxic")}
    walked = cells.select("part", F.flatten(F.transform(_orders(), lambda o: _walk(o, cell))).alias("places"))
    add = lambda a, b: F.struct(a["bit"].alias("bit"), *[(a[c] + b[c]).alias(c) for c in _SUMS])
    vectors = F.collect_list("places")  # one for each mask: at most 32
    merged = walked.groupBy("part").agg(vectors.alias("vectors")).select("part", F.aggregate(
        F.slice("vectors", 2, 1 << len(FILTERS)), F.element_at("vectors", 1), lambda sums, v: F.zip_with(sums, v, add)).alias("places"))
    out = merged.select("part", F.posexplode("places").alias("at", "place"))
    n = len(FILTERS)
    return out.select(
        "part",
        F.element_at(F.split(F.lit(" ".join(ORDERS)), " "), (F.floor(F.col("at") / n) + 1).cast("int")).alias("filter_order"),
        (F.col("at") % n + 1).cast("int").alias("step"),
        *[F.col(f"place.{c}").alias(c) for c in _SUMS],
        F.sum("place.removed").over(Window.partitionBy("part", "place.bit")).alias("shapley"),  # 120 rows, where the part already is
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, for each source."""
    return interactions(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs),
marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(
      CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failed
  FROM worded LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
places AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before
  FROM orders, range(1, 6) r(s)),
audit AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept,
    sum(n) FILTER (WHERE NOT gone AND fails) AS removed,
    sum(n) FILTER (WHERE gone AND fails) AS redundant,
    sum(n) FILTER (WHERE failed = f) AS unique_fails,
    sum(good) FILTER (WHERE NOT gone AND fails) AS good_lost,
    sum(toxic) FILTER (WHERE NOT gone AND fails) AS toxic_lost
  FROM (SELECT *, contains(failed, f) AS fails, failed <> translate(failed, before, '') AS gone FROM cells, places)
  GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM audit
"""
