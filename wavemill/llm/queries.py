"""The registered queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dedup, filters, lines, topk
from .blocks import op11_blocks
from .decontam import op7_decontam
from .dedup import op1_neardup
from .filters import op12_filters
from .langid import op2_langid
from .license import op9_licenses
from .lines import op4_lines
from .mixing import op8_mixing
from .pii import op6_pii
from .sharding import op3_sharding
from .substrings import op5_substrings
from .topk import op10_topk
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_langid": op2_langid,
    "op3_sharding": op3_sharding,
    "op4_lines": op4_lines,
    "op5_substrings": op5_substrings,
    "op6_pii": op6_pii,
    "op7_decontam": op7_decontam,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_topk": op10_topk,
    "op11_blocks": op11_blocks,
    "op12_filters": op12_filters,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op1_neardup": dedup.ORACLE, "op4_lines": lines.ORACLE, "op7_decontam": decontam.ORACLE, "op10_topk": topk.ORACLE, "op12_filters": filters.ORACLE}
