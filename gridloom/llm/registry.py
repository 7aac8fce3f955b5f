"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from gridloom.llm import chat, decontaminate, fingerprints, jaccard_join, language_id, mixing, pii, token_counts, token_output, warc


def queries():
    """Query name -> function of (spark, sf_dir)."""
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_personal_data": pii.op5_personal_data,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_output": token_output.op8_token_output,
        "op9_language_id": language_id.op9_language_id,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql():
    """Query name -> DuckDB SQL over the same tables."""
    return {"op1_chat_format": chat.OP1_SQL, "op4_jaccard_join": jaccard_join.OP4_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op10_warc": warc.OP10_SQL}
