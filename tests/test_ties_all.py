"""The other queries that read the batch spot, on lines that share order and line number."""

import pytest

from test_ties import compare, entry_points, tied  # noqa: F401


@pytest.mark.parametrize("name", ["agg_22_cross_tab", "agg_3_psi", "agg_6_node_values", "agg_7_display_weights", "fit_12_all_variants", "fit_12_variant_sweep",
                                  "fit_12_variants_by_day", "fit_14_miss_summary"])
def test_first_row_of_equal_keys(spark, tied, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(compare, "SF", tied)
    status, note, _, _ = compare.check(spark, compare.duck(), name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note
