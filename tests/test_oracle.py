"""Registered queries agree with their DuckDB oracle (multiset compare)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from specweave.plans.queries import QUERIES
from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["split_map", "tokenize_counts", "marker_positions", "section_lengths", "ir_vector_parse",
        "err_ir_vector", "first_error_per_split", "peak_pairs", "err_spectrum", "err_spectrum_values", "rejects", "enrich_join",
        "mismatch_examples", "msms_split_summary", "explode_energies", "eval_subset_msms",
        "align_full_outer", "alignment_gap", "consecutive_runs", "verify_lengths", "summary_json"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_registry_is_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(QUERIES) >= 55 and set(QUERIES) <= set(o)   # every query of its own has an oracle


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == exp
