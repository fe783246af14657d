"""The registered queries of this subpackage."""

from __future__ import annotations

from .decontaminate import op3_decontamination
from .html_text import op2_html_text
from .line_dedup import ORACLE_OP9, op9_line_dedup
from .mixing import op1_source_mixing
from .near_dedup import op7_near_dedup
from .quality_classifier import op4_quality_classifier
from .quality_rules import op6_quality_rules
from .substring_dedup import op10_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op8_token_files

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_text": op2_html_text,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_files": op8_token_files,
}
ORACLES: dict[str, str] = {"op9_line_dedup": ORACLE_OP9}
