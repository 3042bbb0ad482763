"""Trackers as a table function: its rows are those of the DataFrame calls."""

import pytest

from courtflux.operators import tables, tracking


def _rows(spark):
    """Two videos of three players that walk past each other, one of them away for some frames."""
    rows = []
    for v in range(2):
        for f in range(30):
            for k, x in enumerate((100 + 9 * f, 400 - 9 * f, 700 + f)):
                if not (k == 2 and 10 <= f < 14):
                    reid = [1.0 if i == k else 0.1 for i in range(3)]
                    rows.append((v, f, k, x, 200 + 5 * k, x + 40, 320 + 5 * k, 0.9, (x + 20) / 1920 * 28 - 14, 2.0 + k, reid, reid, "kept"))
    names = "video_id long, frame_id long, det_idx long, x1 long, y1 long, x2 long, y2 long, confidence double, court_x double, court_y double, reid array<double>, color array<double>, note string"
    return spark.createDataFrame(rows, names).repartition(3)


def _ids(df):
    return sorted((r.video_id, r.frame_id, r.det_idx, r.player_id, r.note) for r in df.collect())


@pytest.mark.parametrize("name", ["court", "appearance", "flow"])
def test_equals_calls(spark, name):
    rows = _rows(spark)
    tables.register(spark)
    call = {"court": tracking.track_court, "flow": tracking.track_flow}.get(name, lambda r: tracking.track_appearance(r))
    rows.createOrReplaceTempView("walkers")
    got = spark.sql(f"SELECT * FROM track(TABLE(walkers), '{name}')")
    assert got.columns == [*rows.columns, "player_id"]
    assert _ids(got) == _ids(call(rows)) and len(_ids(got)) == rows.count()
    assert spark.sql(f"SELECT count(*) FROM track(TABLE(SELECT * FROM walkers WHERE video_id > 5), '{name}')").first()[0] == 0


def test_own_tracker_and_faults(spark):
    """A tracker of the caller's; names and tables that don't fit are refused when the query is analysed."""
    rows = _rows(spark)
    rows.createOrReplaceTempView("walkers")
    tables.register(spark, {"last": lambda: lambda frame: [(r, r["det_idx"] + 7) for r in frame or []]})
    got = spark.sql("SELECT DISTINCT player_id - det_idx AS d FROM track(TABLE(walkers), 'last')")
    assert [r.d for r in got.collect()] == [7]
    with pytest.raises(Exception, match="one of appearance, court, flow, last"):
        spark.sql("SELECT * FROM track(TABLE(walkers), 'none')").collect()
    with pytest.raises(Exception, match="lacks x1"):
        spark.sql("SELECT * FROM track(TABLE(SELECT video_id, frame_id, det_idx, y1, x2, y2 FROM walkers), 'court')").collect()
