"""Plan shape: the properties the design relies on, checked on the physical plan."""

from orderpulse.operators import features as feat
from orderpulse.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_build_one_shuffle_per_input(spark):
    plan = _plan(feat.order_features(catalog.tables(spark, SF), fused=True))
    # reviews, items and payments each hash on order_id exactly once
    assert plan.count("Exchange hashpartitioning") == 3
    assert "hashpartitioning(product_id" not in plan  # dimensions are broadcast
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_drift_and_metrics_have_no_pair_joins(spark):
    for name in ("psi_matrix", "ks_matrix", "roc_auc", "threshold_sweep", "validate_json_batches"):
        plan = _plan(catalog.QUERIES[name](spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (name, bad)


def test_checkpoint_dir_required_on_a_cluster():
    """No machine-local fallback unless the master is local."""
    import pytest

    from orderpulse.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("must not set a local folder on a cluster")

    class Ctx:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Ctx()

    with pytest.raises(RuntimeError, match="shared folder"):
        ensure_checkpoint_dir(Session())
