"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trolley.llm.bpe import op3_bpe
from trolley.llm.chat import op11_chat_format
from trolley.llm.decontamination import op8_decontamination
from trolley.llm.html_text import op5_html_text
from trolley.llm.line_dedup import op7_line_dedup
from trolley.llm.near_dedup import op2_near_dedup
from trolley.llm.oracle import ORACLES  # noqa: F401
from trolley.llm.quality import op6_quality
from trolley.llm.resampling import op12_resampling
from trolley.llm.sharding import op1_sharding
from trolley.llm.source_audit import op13_source_audit
from trolley.llm.token_files import op4_token_files
from trolley.llm.toxicity import op9_toxicity
from trolley.llm.url_filter import op10_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def QUERIES() -> dict[str, Query]:
    found = (
        op1_sharding,
        op2_near_dedup,
        op3_bpe,
        op4_token_files,
        op5_html_text,
        op6_quality,
        op7_line_dedup,
        op8_decontamination,
        op9_toxicity,
        op10_url_filter,
        op11_chat_format,
        op12_resampling,
        op13_source_audit,
    )
    return {f.__name__: f for f in found}
