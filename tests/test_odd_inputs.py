"""Queries on odd values against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.plans.registry import oracle_sql, queries


@pytest.fixture
def agree(spark, tmp_path):
    def check(query, table, columns):
        path = f"{tmp_path}/{table}.parquet"
        pq.write_table(pa.table(columns), path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
        found = con.execute(oracle_sql()[query])
        names = [c[0] for c in found.description]
        want = {r[0]: r[1:] for r in found.fetchall()}
        assert {r[0]: tuple(r)[1:] for r in queries()[query](spark, str(tmp_path)).select(*names).collect()} == want

    return check


def test_proper_nouns_with_odd_blanks_and_marks(agree):
    texts = [None, "", "Ann\x0bLee", '"Zed" "Quorn', "'Zed' Quorn!!", "Ab!\u2028", "Abc!\u0085 D!\u2029 x", "Ab\xa0Cd \u2003Ef Über\x1cA", "Ann\r\nLee\x0cKim\tBo", "A\x00bc Éva 😀Ab"]
    agree("fil_18_proper_nouns", "documents", {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def test_percent_of_halves(agree):
    balances = [None, *(k * 100 + 50.0 for k in range(-100, 100)), 0.0, -0.01, 5749.99, 5750.01]
    agree("fn_17_percent", "customer", {"c_custkey": pa.array(range(len(balances)), pa.int64()), "c_acctbal": pa.array(balances, pa.float64())})
