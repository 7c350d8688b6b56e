"""Registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .conversations import OP11_SQL, op11_conversation_repair
from .decontaminate import op3_decontamination
from .exact import OP13_SQL, op13_exact_dedup
from .jaccard import OP1_SQL, op1_ngram_jaccard
from .lines import OP6_SQL, op6_line_dedup
from .packing import op10_best_fit_packing
from .pitman_yor import op4_pitman_yor
from .quality import OP7_SQL, op7_quality_rules
from .substring import OP9_SQL, op9_substring_dedup
from .suffixes import op2_suffix_dedup
from .token_files import op5_token_files
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_suffix_dedup, op3_decontamination, op4_pitman_yor, op5_token_files, op6_line_dedup, op7_quality_rules, op8_toxicity, op9_substring_dedup, op10_best_fit_packing, op11_conversation_repair, op12_collocations, op13_exact_dedup)}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL, "op6_line_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "op9_substring_dedup": OP9_SQL,
    "op11_conversation_repair": OP11_SQL, "op12_collocations": OP12_SQL, "op13_exact_dedup": OP13_SQL}
