"""Every registered query next to its SQL, and the keyed ones again with nearly all users sliced."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect
from builders import SF
from tidemark.operators.slicing import HOT_KEY_SETTING
from tidemark.plans.catalog import ORACLES, QUERIES

KEYED = [n for n in QUERIES if n[:2] in {"t1", "t2", "t3", "t4", "t5", "t6", "t8", "c1", "c2", "c3", "c4", "c6",
                                                    "j1", "j2", "u1", "u2", "m1", "m2", "m4"} or n[:3] in {"e19", "x12"}]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, _, good = compare(spark, con, name, SF)
    assert good, text
    assert "odd SQL types" not in text and "types:" not in text, text


@pytest.mark.parametrize("name", KEYED)
def test_sliced(spark, con, name):
    spark.conf.set(HOT_KEY_SETTING, "10")
    try:
        text, _, good = compare(spark, con, name, SF)
    finally:
        spark.conf.unset(HOT_KEY_SETTING)
    assert good, text


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
