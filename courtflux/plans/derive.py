"""Tracking tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship

DET = """
SELECT video_id, frame_id, det_idx,
  CASE WHEN det_idx = 0 THEN 0 WHEN det_idx = 1 THEN 10 WHEN det_idx = 2 THEN 9 WHEN det_idx = 3 THEN 1 WHEN o_custkey % 7 = 0 THEN 3 ELSE 2 END AS class_id,
  CAST((o_custkey * 37 + det_idx * 101) % 1000 AS DOUBLE) / 1000 AS confidence,
  CASE WHEN det_idx = 0 THEN bx + 20 + o_custkey % 90 WHEN det_idx = 3 THEN bx + 20 ELSE bx + o_custkey % 5 END AS x1,
  CASE WHEN det_idx = 0 THEN by0 + 60 WHEN det_idx = 3 THEN by0 + 40 ELSE by0 END AS y1,
  CASE WHEN det_idx = 0 THEN bx + 40 + o_custkey % 90 WHEN det_idx = 3 THEN bx + 45 ELSE bx + 60 + o_custkey % 5 END AS x2,
  CASE WHEN det_idx = 0 THEN by0 + 80 WHEN det_idx = 3 THEN by0 + 65 ELSE by0 + 140 + o_custkey % 9 END AS y2
FROM (
  SELECT *, 150 + (lane - 4) * 200 + (frame_id * (lane + 1)) % 160 AS bx, 300 + (lane * 53 + frame_id * 2) % 300 AS by0 FROM (
    SELECT *, CASE WHEN det_idx = 0 THEN 4 + CAST((frame_id - frame_id % 20) / 20 AS BIGINT) % 8 WHEN det_idx = 3 THEN 5 ELSE det_idx END AS lane FROM (
      SELECT CAST((g - g % 250) / 250 AS BIGINT) AS video_id, g % 250 AS frame_id, det_idx, o_custkey FROM (
        SELECT CAST((o_orderkey - o_orderkey % 12) / 12 AS BIGINT) AS g, o_orderkey % 12 AS det_idx, o_custkey FROM orders) k) f) h) b
"""

TABLES = {
    "det": DET,
    # Tracked players: det_idx 4..11 are players 1..8 in two teams.
    "players": "SELECT *, det_idx - 3 AS player_id, (det_idx - 3) % 2 AS team_id, class_id = 3 AS is_dribble FROM det WHERE class_id BETWEEN 2 AND 8",
    "balls": "SELECT * FROM det WHERE class_id = 0",
    "numbers": "SELECT * FROM det WHERE class_id = 1",
    "referees": "SELECT * FROM det WHERE class_id = 9",
    # A homography for two frames of three.
    "homographies": "SELECT DISTINCT video_id, frame_id, frame_id % 7 AS k, video_id % 3 AS m FROM det WHERE frame_id % 3 <> 2",
    # Frame labels of shots from a user's events in order: click 1, purchase 2, else 0.
    "labels": """SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id,
      CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS label, value FROM events""",
    # Appearance vectors: eight rows a frame.
    "vectors": "SELECT vec_id, CAST((vec_id - vec_id % 8) / 8 AS BIGINT) AS frame_id, vec_id % 8 AS player_id, label, embedding FROM embeddings",
}
SOURCES = {"det": "orders", "labels": "events", "vectors": "embeddings"}


class Tables:
    """The derived tables of a folder of driver tables, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        source = SOURCES.get(name, "det")
        frame = self.read(source) if name in SOURCES else getattr(self, source)
        return self.spark.sql(TABLES[name].replace(f"FROM {source}", f"FROM {{{source}}}", 1), **{source: frame})


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the common table expressions that it names (and those that they need)."""
    need: list[str] = []
    for n in names:
        if n not in SOURCES and "det" not in need:
            need.append("det")
        if n not in need:
            need.append(n)
    parts = [f"{n} AS ({TABLES[n].strip()})" for n in need]
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        joiner = ",\n"
    else:
        joiner = "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + joiner + rest
