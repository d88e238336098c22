"""The registered queries against DuckDB SQL, where SQL can express them."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from codelens.llm.queries import QUERIES
from tests.conftest import SF_SMALL

WITH_SQL = sorted(n for n, (_, sql) in QUERIES.items() if sql)


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_SMALL}/{file}'")
    fn, sql = QUERIES[name]
    got, want = fn(spark, SF_SMALL).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    bag = lambda d: sorted(repr(tuple(map(plain, r))) for r in d[cols].itertuples(index=False))
    assert bag(got) == bag(want)


def test_one_query_for_each_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_columns(spark):
    """Names and types of the contract, on an empty table too."""
    want = {
        "op1_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op2_": "page_id bigint, url string, text string, n_chars bigint",
        "op3_": "page_id bigint, host string, path string, rule string, verdict string",
        "op4_": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op5_": "doc_id bigint, held_out boolean, score double, predicted int",
        "op6_": "doc_id bigint, fingerprint string, component_id bigint",
        "op7_": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op8_": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op9_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op10_": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        "op11_": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
                 "good_lost bigint, toxic_lost bigint, shapley bigint",
        "op12_": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
                 "runs_sha256 string, collapsed_sha256 string",
        "op13_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    }
    for name, (fn, _) in QUERIES.items():
        got = ", ".join(f"{c} {t}" for c, t in fn(spark, SF_SMALL).dtypes)
        assert got == want[name[: name.index("_") + 1]], name


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, (fn, _) in QUERIES.items():
        got = fn(spark, str(tmp_path)).collect()
        assert len(got) == (1 if name.startswith("op10_") else 0), name  # the injected conversation
