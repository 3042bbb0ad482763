"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import forest, lloyd, ranked, warc
from .interpolate import op7_interpolation
from .langid import op5_langid
from .licenses import op3_licenses
from .media import op6_media
from .packing import op8_packing
from .quality import op2_quality
from .segment import op9_segmentations
from .simhash import op10_simhash
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_warc": warc.op4_warc,
    "op5_langid": op5_langid,
    "op6_media": op6_media,
    "op7_interpolation": op7_interpolation,
    "op8_packing": op8_packing,
    "op9_segmentations": op9_segmentations,
    "op10_simhash": op10_simhash,
    "op11_forest": forest.op11_forest,
    "op12_lloyd": lloyd.op12_lloyd,
    "op13_ranked": ranked.op13_ranked,
}

#: Queries without SQL have methods beyond it; the tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op11_forest": forest.ORACLE,
    "op12_lloyd": lloyd.ORACLE,
    "op13_ranked": ranked.ORACLE,
}
