"""Registered queries: SQL where it is given is for a registered query, and the flagship query runs."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "j1_nearest", "q3_dropout_budget", "w2_sample_by_distance", "j11_revisit_candidates", "a24_holes_filled", "t6_components", "w11_course", "w14_w16_jump_audit", "w27_tilt", "w28_dual_antenna",
    "c7_temporal_filter", "q10_subset_digest", "src3_file_stamps", "src6_rig_trajectory", "src7_camera_priors", "snk1_published", "snk2_trajectory_lines", "snk3_overlap_lines", "a9_similarity_scale",
    "a36_motion_correlations", "a38_overlap_report", "a49_refinement_acceptance", "a53_reprojection", "a57_scene_completeness", "a58_submap_acceptance", "a59_assembly_acceptance", "j16_adjacent_tiles",
    "g10_camera_from_antenna", "g14_time_keys", "g17_reached", "s3_difference", "s4_distinct_cells", "s5_concatenated", "r3_time_window", "r4_out_of_order", "r5_distance_samples", "r6_streamed_nearest",
    "src5_pose_models", "src8_depth_pixels", "c12_initial_cloud", "a29_corrected_psnr", "a32_profile_summary", "c15_calibration_fixes", "c15_calibration_frames", "q5_migrated", "c4_truth_observations",
    "c6_pose_export", "c9_gauges", "c3_dual_positions", "c10_assembled_poses", "c13_scene_evaluation", "c14_seam_probe", "src1_observations", "t11_recomputed_counts", "p21_view_counts",
])
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    sql = con.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in sql.fetchall())


def test_percentiles_are_not_kept_for_each_distinct_value(spark):
    df = entry.queries()["a49_refinement_acceptance"](spark, "/root/testdata/sf0.001")
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 8 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey").distinct().count()
    # a distinct count beside a percentile groups the percentile by the distinct value first
    assert "distinct " not in df._jdf.queryExecution().optimizedPlan().toString()
