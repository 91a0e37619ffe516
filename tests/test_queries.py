"""Every query against its SQL twin, and the driver contract."""

import pytest

import __spark_entry__ as entry
from compare import SF, connect, difference

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
BLOCKS = ["tx_velocity_1h_6h", "amount_zscore_running", "device_switch_flag", "merchant_rate_limit_2d",
          "latency_quantiles_1d", "state_machine_audit", "live_features", "reconstruct_features"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLE[name]) == ""


@pytest.mark.parametrize("name", BLOCKS)
def test_matches_sql_over_many_blocks(spark, duck, many_blocks, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLE[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    learned = {"model_auc", "risk_score"}
    assert {q for q in set(QUERIES) - set(ORACLE) if q != "pipeline" and not q.startswith("op")} == learned


def test_entry(spark):
    df = entry.entry(spark)
    assert "transaction_count" in df.columns and df.count() > 0


def test_replay_invariants(spark):
    for r in QUERIES["reconstruct_features"](spark, SF).collect():
        assert all(v is not None for v in r)
        assert 0 <= r.hour_of_day <= 23 and r.tx_velocity_5m >= r.tx_velocity_1m >= 1
        assert r.amount_cents_log > 0 and r.device_switch_flag == 0
