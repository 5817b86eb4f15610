"""The driver's contract: queries run on the smallest tables and agree with their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from billweave.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["detect_cpt", "csv_zip_explode", "dup_pairs_adjacent", "components", "consensus_pick", "model_rank_composite", "anonymize_patient", "superbill_extract", "code_cluster_islands", "chunk_grid", "extracted_records", "optimised_records", "validation_reports", "context_change", "boundary_validated", "text_segments", "boundary_clusters", "structured_patients", "date_list", "chunk_layout", "boundary_enhanced", "boundary_identifiers"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return str(v) if v is not None else None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str)
    quoted = ", ".join(f'"{c}"' for c in names)
    want = sorted((tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({ORACLES[name]})").fetchall()), key=str)
    assert [tuple(map(number, r)) for r in rows] == [tuple(map(number, r)) for r in want]


def number(x):
    try:
        return round(float(x), 4)
    except (TypeError, ValueError):
        return x
