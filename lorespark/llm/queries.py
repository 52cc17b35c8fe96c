"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.chunk_fingerprint import op2_chunk_fingerprint
from lorespark.llm.mixing import op4_mixing
from lorespark.llm.packing import op5_packing
from lorespark.llm.quality import op8_quality
from lorespark.llm.sharding import op3_sharding
from lorespark.llm.simhash import op10_simhash
from lorespark.llm.suffix_dedup import op1_suffix_dedup
from lorespark.llm.topk import ORACLE as TOPK_SQL, op6_topk
from lorespark.llm.url_filter import op9_url_filter
from lorespark.llm.warc import ORACLE as WARC_SQL, op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_chunk_fingerprint": op2_chunk_fingerprint, "op3_sharding": op3_sharding, "op4_mixing": op4_mixing, "op5_packing": op5_packing, "op6_topk": op6_topk, "op7_warc": op7_warc, "op8_quality": op8_quality, "op9_url_filter": op9_url_filter, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": TOPK_SQL, "op7_warc": WARC_SQL}
