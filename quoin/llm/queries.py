"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat
from .decontaminate import op6_decontaminate
from .htmltext import op8_html
from .jaccard import OP10_SQL, op10_jaccard_join
from .langid import op2_language
from .mixing import op1_mixing
from .ngramlm import op9_lm
from .quality import op7_quality
from .topk import OP4_SQL, op4_topk
from .toxicity import op3_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_chat": op5_chat,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_html": op8_html,
    "op9_lm": op9_lm,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {"op4_topk": OP4_SQL, "op5_chat": OP5_SQL, "op10_jaccard_join": OP10_SQL}
