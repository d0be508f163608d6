"""Queries over the training-data operators, and their SQL where it can express them on whole tables."""

from __future__ import annotations

from .backoff import op10_stupid_backoff
from .decontaminate import op5_fm_index
from .hosts import op3_host_reputation
from .licenses import op1_license_index
from .oracle import OP4, OP5
from .packing import op6_pattern_packing
from .pii import op7_bootstrapped_pii
from .quality import op2_divergence
from .repeats import op4_seed_extend
from .simhash import op9_simhash
from .toxicity import op8_weak_supervision

QUERIES = {
    "op1_license_index": op1_license_index,
    "op2_divergence": op2_divergence,
    "op3_host_reputation": op3_host_reputation,
    "op4_seed_extend": op4_seed_extend,
    "op5_fm_index": op5_fm_index,
    "op6_pattern_packing": op6_pattern_packing,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_simhash": op9_simhash,
    "op10_stupid_backoff": op10_stupid_backoff,
}

ORACLE_SQL: dict[str, str] = {"op4_seed_extend": OP4, "op5_fm_index": OP5}
