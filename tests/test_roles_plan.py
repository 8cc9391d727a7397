"""The role resolver sends no table of builds' methods through the driver."""

from ledgerwing.operators import roles
from ledgerwing.plans import override_queries as oq
from ledgerwing.stores import saved


def test_no_broadcast(spark):
    methods = saved(oq._role_methods(spark, "/root/testdata/sf0.001"))
    made = methods.selectExpr("o_custkey", "'Lopt;' AS owner").distinct()
    got = roles.resolve_build(methods, made, ["o_custkey"], oq.ROLES, oq.ROLE_LABELS)
    assert got.collect() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
