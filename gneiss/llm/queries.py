"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, hpylm, html, jaccard, mixing, rollup, secrets, toxicity, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_chat": chat.op3_chat,
    "op4_topk": vafile.op4_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_tokens": rollup.op7_tokens,
    "op8_html": html.op8_html,
    "op9_hpylm": hpylm.op9_hpylm,
    "op10_decontam": decontam.op10_decontam,
}

ORACLES: dict[str, str] = {"op1_mixing": mixing.OP1_SQL, "op4_topk": vafile.OP4_SQL, "op6_jaccard": jaccard.OP6_SQL}
