"""Registered queries against their oracle SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from citeloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6)
    return str(value)


def table(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, db, name):
    frame = catalog.queries()[name](spark, SF)
    found = db.sql(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = sorted(frame.columns)
    assert sorted(names) == order
    assert table(frame.collect(), frame.columns, order) == table(found.fetchall(), names, order)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["stream_once", "stream_coalesce"])
def test_streams_leave_files_beside_their_checkpoint(spark, tmp_path, monkeypatch, name):
    from citeloom.plans import streams

    monkeypatch.setattr(streams, "shared_dir", lambda _: f"file://{tmp_path}", raising=False)
    frame = catalog.queries()[name](spark, SF)
    assert frame.count() > 0 and all(f.startswith(f"file://{tmp_path}") or f.startswith(f"file:{tmp_path}") for f in frame.inputFiles()) and frame.inputFiles()
    assert glob.glob(f"{tmp_path}/stream-*/state/offsets/*")


def test_flagship_cites(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and all(r["file_path"] and r["evidence"] >= 0.35 for r in rows)
