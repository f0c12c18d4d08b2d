"""Every registered query of the media operators against its SQL in DuckDB, over whole tables."""

import pytest

from kinoframe.plans import registry
from tests.compare import differences, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_its_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_folds_keep_their_rows(spark, name):
    """Queries without SQL have their values tested in test_folds; here, that they run over whole tables."""
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_training_operators():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_visible_events_of_a_long_script(spark, tmp_path):
    turns = spark.createDataFrame([(1, turn, "user", "x" * 100) for turn in range(50)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.read_order for r in registry.QUERIES["visible_events"](spark, str(tmp_path)).collect()} == set(range(50))
