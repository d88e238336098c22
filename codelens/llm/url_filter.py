"""URL rules by a sort-merge range join over reversed-host keys.

A host's key is its labels from the last to the first, each ended by a zero
character (``blog.example.org`` -> ``org\\0example\\0blog\\0``), so the hosts
under a rule's host are one interval of keys. URLs and rules are dealt to key
ranges and sorted together; one sweep over the sorted rows keeps a stack of
the rules whose interval is open. Each stack level holds the path prefixes of
its host; the longest rule (host and path together) that fits wins, the deeper
host on equal length.

A rule is copied into each key range that its interval meets, so a range needs
nothing from its neighbours. Range bounds are (key, hash of the id) pairs from
a bounded sample (BOUND_SAMPLE keys), so one host with a third of all rows is
split too; a range of any size is swept as a stream.

Defined results: null URL or one without ``://`` has empty host and path and
fits no rule; of rules that repeat a (host, path) the blocking one counts;
without rules each URL gets the default verdict; repeated rows stay.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.common import ascii_lower, parts_for, table

#: Keys sampled for the range bounds, and URLs that one range holds on average (ranges: 4096 at most).
BOUND_SAMPLE, URLS_PER_RANGE, MAX_RANGES = 20_000, 50_000, 4096
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: What a URL without a fitting rule gets.
DEFAULT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL as the contract cuts them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\u0000"), F.lit("\u0000")))


def _range_of(bounds: list[tuple[str, int]]):
    """Adds the key range of each URL."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["bucket"] = [bisect.bisect_right(bounds, x) for x in zip(pdf["key"], pdf["tie"], strict=True)]
            yield pdf
    return deal


def _ranges_of_rule(bounds: list[tuple[str, int]]):
    """A copy of each rule for every key range that its interval meets."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [range(bisect.bisect_left(bounds, (k, -(2**63))), bisect.bisect_right(bounds, (k[:-1] + "\u0001", -(2**63))) + 1) for k in pdf["key"]]
            pdf["bucket"] = spans
            yield pdf.explode("bucket", ignore_index=True).astype({"bucket": "int32"})
    return deal


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, stack = None, []  # stack: (key, host, {path: verdict}, path lengths from long to short)
        for pdf in batches:
            out = []
            for b, key, kind, row_id, url, host, path, verdict in zip(
                    pdf["bucket"], pdf["key"], pdf["kind"], pdf["id"], pdf["url"], pdf["host"], pdf["path"], pdf["verdict"], strict=True):
                if b != bucket:
                    bucket, stack = b, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, lengths = stack[-1]
                    paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, rule_host, paths, lengths in reversed(stack):
                    # the exact check: a label holding the separator could fake a prefix
                    if not (host == rule_host or host.endswith("." + rule_host)):
                        continue
                    n = next((n for n in lengths if n <= len(path) and path[:n] in paths), None)
                    if n is not None and (best is None or len(rule_host) + n > len(best[0])):
                        best = (rule_host + path[:n], paths[path[:n]])
                out.append((row_id, url, host, path, best and best[0], best[1] if best else default))
            yield pd.DataFrame(out, columns=["id", "url", "host", "path", "rule", "verdict"])
    return run


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(key, url, host, path, rule, verdict) for every row of ``urls``; rules: (host, path, verdict)."""
    spark = urls.sparkSession
    host, path = url_parts(F.col(url))
    rows = urls.select(F.col(key).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path")).select(
        "id", "url", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id").alias("tie"))
    n = rows.count()
    ranges = min(MAX_RANGES, parts_for(n, URLS_PER_RANGE, spark.sparkContext.defaultParallelism))
    # the sampled keys are bounded, whatever the table holds
    some = rows.select("key", "tie").sample(min(1.0, BOUND_SAMPLE / max(1, n)), seed=7).limit(2 * BOUND_SAMPLE)
    sample = sorted((r[0], r[1]) for r in some.collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    id_type = rows.schema["id"].dataType.simpleString()
    kinds = f"id {id_type}, url string, host string, path string, key string, tie long, kind int, verdict string, bucket int"
    lead = rows.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")}).mapInPandas(_range_of(bounds), kinds)
    r_host = ascii_lower(F.col("host"))
    listed = rules.select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("url"), r_host.alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), host_key(r_host).alias("key"), F.lit(0).cast("long").alias("tie"), F.lit(0).alias("kind"), "verdict",
    ).filter("host is not null and host <> ''")
    both = lead.unionByName(listed.mapInPandas(_ranges_of_rule(bounds), kinds))
    dealt = both.repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", "kind", "tie", "path")
    return dealt.mapInPandas(
        _sweep(default), f"id {id_type}, url string, host string, path string, rule string, verdict string"
    ).withColumnRenamed("id", key)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
    SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
    FROM parts p LEFT JOIN rules r
      ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
