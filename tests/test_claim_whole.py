"""Every order is a claim or a candidate."""

from quarry import queries
from quarry.plans.graph_view import table


def test_orders_have_a_role(spark, tiny):
    wanted = {r.o_orderkey for r in table(spark, tiny, "orders").where("o_custkey % 3 <> 0").collect()}
    found = queries.queries()["f03_classify"](spark, tiny).collect()
    assert len(found) == len(wanted) and {r.candidate_id for r in found} == wanted
