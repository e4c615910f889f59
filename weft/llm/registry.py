"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from weft.llm.exact import OP9_SQL, op9_exact
from weft.llm.language import op10_language
from weft.llm.lm import op3_lm
from weft.llm.mixing import OP7_SQL, op7_mixing
from weft.llm.pieces import op4_pieces
from weft.llm.quality import op2_quality
from weft.llm.secrets import op8_secrets
from weft.llm.simhash import op5_simhash
from weft.llm.topk import OP6_SQL, op6_topk
from weft.llm.toxicity import op1_toxicity


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_lm": op3_lm, "op4_pieces": op4_pieces, "op5_simhash": op5_simhash, "op6_topk": op6_topk, "op7_mixing": op7_mixing, "op8_secrets": op8_secrets, "op9_exact": op9_exact, "op10_language": op10_language}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op7_mixing": OP7_SQL, "op9_exact": OP9_SQL}
