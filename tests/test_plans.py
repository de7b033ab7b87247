"""Plans: what scans must prune and which side must not be shuffled."""

import __spark_entry__ as entry_point
from stubble.queries.base import samples
from stubble.queries.publishing import LEVEL3, _shown
from tests.compare import plan_of

SF_DIR = "/root/testdata/sf0.001"


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(samples(spark, SF_DIR).select("ID2", "BiomassSampleArea"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(entry_point.queries()["filtered_samples"](spark, SF_DIR))
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_rules_and_group_means_do_not_shuffle_the_samples(spark):
    for name in ("check_bounds", "check_observation"):
        assert "BroadcastHashJoin [__crop" in plan_of(entry_point.queries()[name](spark, SF_DIR))
    for name in ("moisture_gapfill", "outlier_class", "regression_gapfill", "tiered_mean_gapfill"):
        assert "Exchange hashpartitioning" not in plan_of(entry_point.queries()[name](spark, SF_DIR))


def test_two_columns_of_the_raw_level_are_not_broadcast(spark, tmp_path):
    wide = "HarvestYear int, ID2 long, Crop string, GrainMassWet_P1_qcResult string"
    audited = [f"{c}{a} {t}" for c in ["GrainYieldAirDry_P2", *LEVEL3] for a, t in (("", "double"), ("_qcApplied", "string"), ("_qcResult", "string"))]
    spark.createDataFrame([(1999, 1, "WW", "000001"), (1999, None, "WW", None)], wide).write.parquet(f"{tmp_path}/first")
    last = spark.createDataFrame([(1999, 1, "WW", *(1.0, "1", "0") * 3)], ", ".join(["HarvestYear int, ID2 long, Crop string", *audited]))
    shown = _shown(spark.read.parquet(f"{tmp_path}/first"), last)
    assert "SortMergeJoin" in plan_of(shown) and "Broadcast" not in plan_of(shown)
    assert [(r["ID2"], r["flagged"]) for r in shown.collect()] == [(1, 1)]
