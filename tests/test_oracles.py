"""Every registered query against its DuckDB statement on the smallest data
(the driver repeats this at sf0.01), and the entry contract."""

import pytest
from conftest import SF_SMALL
from oracle_util import assert_matches_oracle

import __spark_entry__ as ent
from quarry.plans.registry import REGISTRY

NAMES = sorted(REGISTRY)
WITH_ORACLE = [n for n in NAMES if n in ent.oracle_sql()]


def test_every_query_has_an_oracle():
    assert NAMES == WITH_ORACLE


@pytest.mark.parametrize("name", [n for n in WITH_ORACLE if not n.startswith("tick_")])
def test_oracle(spark, duck, name):
    assert_matches_oracle(spark, duck(SF_SMALL), name, SF_SMALL)


def test_entry(spark):
    df = ent.entry(spark)
    assert df.columns == ["instrument", "ts_day", "trades", "avg_price", "sum_price", "wavg_price"]
    assert df.count() > 0


def test_run_log_row(spark):
    df = ent.queries()["mart_run_log"](spark, SF_SMALL)
    r = df.first()
    assert r.status == "success" and r.message == "success" and r.chunk_count > 0
