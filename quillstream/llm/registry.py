"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversation_repair, decontamination, line_dedup, mixing, quality_rules, ranked_search, secret_scan, shingle_join
from . import substring_dedup, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_output": token_output.op7_token_output,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_shingle_join": shingle_join.op10_shingle_join,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_mixing": mixing.op13_mixing,
}
SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_decontamination": decontamination.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_shingle_join": shingle_join.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_mixing": mixing.SQL,
}
