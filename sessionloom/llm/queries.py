"""The queries of this package, and SQL for those that SQL can express."""

from .exact_dedup import OP4_SQL, op4_digest_index
from .html_text import op10_block_rules
from .language import op3_rank_order
from .line_quality import OP2_SQL, op2_line_quality
from .mixing import OP9_SQL, op9_water_filling
from .near_dedup import op8_probminhash
from .packing import op7_best_fit
from .personal_data import op5_personal_data
from .token_codes import op1_token_codes
from .token_counts import op6_token_counts

QUERIES = {
    "op1_token_codes": op1_token_codes,
    "op2_line_quality": op2_line_quality,
    "op3_rank_order": op3_rank_order,
    "op4_digest_index": op4_digest_index,
    "op5_personal_data": op5_personal_data,
    "op6_token_counts": op6_token_counts,
    "op7_best_fit": op7_best_fit,
    "op8_probminhash": op8_probminhash,
    "op9_water_filling": op9_water_filling,
    "op10_block_rules": op10_block_rules,
}
ORACLE_SQL = {"op2_line_quality": OP2_SQL, "op4_digest_index": OP4_SQL, "op9_water_filling": OP9_SQL}
