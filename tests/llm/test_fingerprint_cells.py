from pyspark.sql import functions as F

from sextant.llm import fingerprint


def test_cells_have_marks_only_where_digests_are_kept(spark):
    """Without them a cell's number is grouped by, and no mark that is the same for all."""
    items = spark.createDataFrame([(1, 0, 8, 1, k) for k in (11, 12, 13)], "rid long, pair int, places int, n int, k long")
    cells = fingerprint.sketched(items, ["rid", "pair"])
    assert "mark" not in cells.columns and "mark" not in fingerprint.peel_round(cells, 0, False).columns
    assert [tuple(r) for r in fingerprint.peeled(cells, False).select("d", "bad").collect()] == [(3, 0)]
    kept = fingerprint.peeled(cells, True).where(F.col("bad") == 0).select("k", "n").collect()
    assert sorted(map(tuple, kept)) == [(11, 1), (12, 1), (13, 1)]
