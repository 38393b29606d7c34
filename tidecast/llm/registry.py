"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op5_decontamination
from .license_scan import OP1_SQL, op1_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .near_dedup import op6_near_dedup
from .piece_sampling import op3_piece_sampling
from .quality_classifier import op8_quality_classifier
from .quality_rules import OP2_SQL, op2_quality_rules
from .secret_scan import OP7_SQL, op7_secret_scan
from .suffix_dedup import op4_suffix_dedup
from .url_filter import op9_url_filter

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
}

SQL = {
    "op1_license_scan": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op7_secret_scan": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
}
