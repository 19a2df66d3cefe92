"""Registered queries against DuckDB: a representative set, or all with ALL_QUERIES=1."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "b01_profile_columns", "b06_missing_report", "b09_target_percentiles", "c01_infer_kinds", "c02_parse_locale_number",
    "c05_extract_dims_pitch", "c09_select_columns_full", "d08_clip_percentile", "d10_quantile_normal_raw",
    "d13_split_stratified", "d15_disassemble", "e03_noise_relative", "e06_assign_labels_knn5", "e10_smote",
    "e11_smogn_regions", "f06_posterior_categorical", "f08_component_shares", "g01_knn_join", "g08_classification_report",
    "h02_ks_two_sample", "p05_tpr_at_fpr",
)
NAMES = [n for n in queries() if n in oracle_sql() and (os.environ.get("ALL_QUERIES") or n in QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    diff, rows, _, _ = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert diff == "" and rows > 0


def test_every_query_is_named_once():
    assert set(oracle_sql()) <= set(queries())
