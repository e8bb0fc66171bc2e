"""Every ledger query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from paperloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose stand-in columns select nothing from tables as small as these.
EMPTY = {"band_filter", "label_anchor_semi", "dual_region_dedup"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return repr(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["kind", "label", "number", "n", "core_lo", "core_hi"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_anomaly_totals(spark, sf_dir):
    """Both kinds are counted, as anomaly_groups holds them."""
    groups = catalogue.QUERIES["anomaly_groups"](spark, sf_dir).toPandas()["kind"].value_counts().to_dict()
    got = {r["kind"]: r["n_groups"] for r in catalogue.QUERIES["anomaly_totals"](spark, sf_dir).collect()}
    assert got == groups and set(got) == {"duplicate", "outlier"}


def test_orders(spark, sf_dir, duck):
    """Duplicates by count, label, number; outliers by label, number from the greatest; months by name: as they are returned."""
    rows = lambda name: [tuple(r) for r in catalogue.QUERIES[name](spark, sf_dir).collect()]
    dups, outs, months = rows("duplicate_groups"), rows("outlier_groups"), rows("month_pending_done")
    assert dups == sorted(dups, key=lambda r: (-r[2], r[0], int(r[1]))) and len(dups) > 5
    assert outs == sorted(outs, key=lambda r: (r[0], -r[1])) and len(outs) > 5
    assert months == sorted(months) and len(months) > 5
    work = rows("work_list")
    assert work == sorted(work) == duck.sql(catalogue.ORACLE_SQL["work_list"]).fetchall()
