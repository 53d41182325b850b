"""Every query of the engine against DuckDB on the same tables."""

import math
import shutil
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from lodestone.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v) if isinstance(v, (datetime, date, Decimal)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    data = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert data
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_footer_files_of_tables_in_folders(spark, sf, tmp_path):
    """A table may be a folder of files, whose names say nothing of it."""
    con = duckdb.connect()
    for t in [*TABLES, "others"]:
        source = f"{sf}/{'region' if t == 'others' else t}.parquet"
        if t in ("documents", "labels", "lineitem", "embeddings"):
            (tmp_path / f"{t}.parquet").mkdir()
            for i in range(3):
                con.sql(f"COPY (SELECT * FROM '{source}' {'LIMIT 20 ' if i < 2 else ''}OFFSET {20 * i}) TO '{tmp_path}/{t}.parquet/part-{i:04d}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        else:
            shutil.copy(source, tmp_path / f"{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = QUERIES["footer_files"](spark, str(tmp_path)), con.sql(ORACLES["footer_files"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
