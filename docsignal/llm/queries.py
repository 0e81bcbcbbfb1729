"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embeddings, language, minhash, mixing, quality, suffix_dedup, tokens, toxicity, warc
from .oracles import ORACLE_SQL as ORACLE_SQL

QUERIES = {
    "op1_token_codes": tokens.op1,
    "op2_toxicity": toxicity.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_embedding_dedup": embeddings.op4,
    "op5_mixing": mixing.op5,
    "op6_minhash": minhash.op6,
    "op7_warc": warc.op7,
    "op8_quality": quality.op8,
    "op9_language": language.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
}
