"""The subpackage's registered queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op11_bpe
from .decontaminate import op1_decontaminate
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op9_fingerprints
from .language_id import op10_language_id
from .language_model import op7_language_model
from .line_dedup import op4_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .paragraph_dedup import op5_paragraph_dedup
from .pieces import op3_pieces
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op6_toxicity
from .weighted_minhash import op2_weighted_minhash

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_weighted_minhash": op2_weighted_minhash,
    "op3_pieces": op3_pieces,
    "op4_line_dedup": op4_line_dedup,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_model": op7_language_model,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_bpe": op11_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
