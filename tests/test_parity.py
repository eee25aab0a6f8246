"""A slice of the registered queries beside their SQL twins at the smallest scale."""
import pytest
from parity import compare, connect

from dipsift import plans

SF = "/root/testdata/sf0.001"
SLICE = ["a20_operating_point_recall", "a21_matched_recall", "w1_event_gap_distance", "w4_tolerance_grouping", "j3_fold_join",
         "j4_nearest_partner", "j8_blocked_cadences", "k1_ranked_queue", "r1_rebalance_stratified", "s4_sector_pairs", "w7_search_events"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SLICE)
def test_query_equals_sql(spark, con, name):
    _, err = compare(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])
    assert err is None, err


def test_every_oracle_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
