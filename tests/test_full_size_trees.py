"""Which trees the model queries ask for; the fits themselves are small here."""

import os

import pytest

from tidemark.operators import models as M
from tidemark.plans.registry import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name,fits", [("L11_selection_stability", 15), ("L15_ablation", 6)])
def test_every_fit_is_of_full_size(spark, monkeypatch, name, fits):
    asked, fit = [], M.train_trees

    def small(rows, features, y, settings=M.TreeSettings(), balanced=True):
        asked.append((settings.trees, settings.rate, settings.depth, settings.sample))
        return fit(rows, features, y, M.TreeSettings(trees=2, rate=0.3, depth=2), balanced)

    monkeypatch.setattr(M, "train_trees", small)
    assert QUERIES[name](spark, SF).count() > 0
    assert asked == [(800, 0.02, 7, 1.0)] * fits


def test_fits_of_a_large_table_run_a_few_at_a_time(spark, monkeypatch):
    rows = spark.range(0, 30, 1, 5)
    read, at_once = M.side_by_side(rows)
    assert at_once == 16 and read.rdd.getNumPartitions() == 1 and read.count() == 30
    monkeypatch.setattr(M, "ROWS_PER_TASK", 29)
    read, at_once = M.side_by_side(rows)
    assert at_once == 4 and read.rdd.getNumPartitions() == 5
