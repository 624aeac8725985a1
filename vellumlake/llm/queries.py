"""The subpackage's queries and the SQL that they are held against."""

from __future__ import annotations

from . import chat, neardup_vectors, negatives, phrases, urls
from .bpe import op6_bpe
from .chat import op9_chat
from .fingerprints import op11_fingerprints
from .langid import op10_language_id
from .lm import op5_lm_scoring
from .minhash import op7_minhash
from .neardup_vectors import op2_embedding_near_dedup
from .negatives import op12_hard_negatives
from .packing import op4_packing
from .phrases import op13_phrases
from .rules import op3_quality_rules
from .simple8b import op8_simple8b
from .urls import op1_url_filter


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_packing": op4_packing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_bpe": op6_bpe,
        "op7_minhash": op7_minhash,
        "op8_simple8b": op8_simple8b,
        "op9_chat": op9_chat,
        "op10_language_id": op10_language_id,
        "op11_fingerprints": op11_fingerprints,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": urls.ORACLE, "op2_embedding_near_dedup": neardup_vectors.ORACLE, "op9_chat": chat.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_phrases": phrases.ORACLE}
