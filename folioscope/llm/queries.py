"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op4_decontaminate
from .language_id import op6_language_id
from .license_scan import op3_license_scan
from .line_dedup import op5_line_dedup
from .lm_score import op10_lm_score
from .pack import op1_pack
from .quality_rules import op9_quality_rules
from .secret_scan import op2_secret_scan
from .shingle_join import op7_shingle_join
from .sql import ORACLE_SQL  # noqa: F401
from .token_files import op8_token_files

QUERIES = {
    "op1_pack": op1_pack,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_shingle_join": op7_shingle_join,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
}
