"""The registered queries of this folder, and DuckDB SQL for those it can express."""

from __future__ import annotations

from . import oracle
from .byte_bpe import op13_byte_bpe
from .chat_format import op9_chat_format
from .decontamination import op6_decontamination
from .fill_in_middle import op11_fill_in_middle
from .jaccard_join import op10_jaccard_join
from .language import op3_language_id
from .packing import op5_best_fit_packing
from .quality import op7_quality
from .substring_dedup import op1_substring_dedup
from .toxicity import op2_toxicity
from .url_filter import op8_url_filter
from .va_search import op4_va_search
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_va_search": op4_va_search,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
