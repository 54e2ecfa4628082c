"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprint, mixing, neardup, revisits, runindex, substrings, tokencount, toolcalls, toxicity

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_revisits": revisits.op2_revisits,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_mix": mixing.op5_mix,
    "op6_substrings": substrings.op6_substrings,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_run_index": runindex.op9_run_index,
    "op10_tool_calls": toolcalls.op10_tool_calls,
}

SQL = {
    "op1_fingerprint": fingerprint.OP1_SQL,
    "op2_revisits": revisits.OP2_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_run_index": runindex.OP9_SQL,
}
