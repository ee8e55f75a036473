"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import line_dedup
from .chat import op7_chat_formatting
from .decontamination import op1_decontamination
from .language_id import op3_language_id
from .line_dedup import op8_line_dedup
from .packing import op2_best_fit_packing
from .personal_data import op4_personal_data
from .quality import op5_quality_rules
from .sharding import op6_sharding
from .simhash import op10_simhash_dedup
from .token_counts import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_best_fit_packing, op3_language_id, op4_personal_data, op5_quality_rules, op6_sharding, op7_chat_formatting, op8_line_dedup, op9_token_counts, op10_simhash_dedup)}
ORACLE_SQL: dict[str, str] = {"op8_line_dedup": line_dedup.ORACLE_SQL}
