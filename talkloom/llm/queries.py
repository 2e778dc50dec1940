"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .fuzzy_hash import op3_fuzzy_fingerprint
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language_id import op4_language_id
from .jaccard_join import op7_jaccard_join
from .line_dedup import OP2_SQL, op2_line_dedup
from .nn_descent import op10_nn_descent
from .packing import op5_best_fit_packing
from .periodic_runs import op11_periodic_runs
from .quality import op6_quality
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op1_toxicity
from .url_filter import OP12_SQL, op12_url_filters

QUERIES = {
    "op7_jaccard_join": op7_jaccard_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op10_nn_descent": op10_nn_descent,
    "op2_line_dedup": op2_line_dedup,
    "op1_toxicity": op1_toxicity,
    "op6_quality": op6_quality,
    "op4_language_id": op4_language_id,
    "op3_fuzzy_fingerprint": op3_fuzzy_fingerprint,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op12_url_filters": OP12_SQL, "op13_hard_negatives": OP13_SQL}
