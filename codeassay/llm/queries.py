"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from codeassay.llm import chat_repair, decontaminate, exact_dedup, filter_audit, host_rules, line_dedup, maxent, mixing, page_diff, partenum, qda, spelling, token_files

QUERIES = {
    "op1_page_diff": page_diff.op1_page_diff,
    "op2_chat_repair": chat_repair.op2_chat_repair,
    "op3_quadratic_quality": qda.op3_quadratic_quality,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_maxent_score": maxent.op6_maxent_score,
    "op7_token_files": token_files.op7_token_files,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": partenum.op9_jaccard_join,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_host_rules": host_rules.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_mixing": mixing.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
