"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pricelens.llm import (
    chat,
    exact,
    lattice,
    mixing,
    near,
    packing,
    phrases,
    quality,
    repeats,
    sharding,
    toxicity,
    variants,
    wacz,
)
from pricelens.llm.ship import on_executors

QUERIES = {
    "op1_wacz": on_executors(wacz.op1_wacz),
    "op2_repeated_spans": on_executors(repeats.op2_repeated_spans),
    "op3_chat_snapshots": chat.op3_chat_snapshots,
    "op4_lattice": on_executors(lattice.op4_lattice),
    "op5_near_dedup": on_executors(near.op5_near_dedup),
    "op6_mixture": mixing.op6_mixture,
    "op7_toxicity": on_executors(toxicity.op7_toxicity),
    "op8_quality": on_executors(quality.op8_quality),
    "op9_packing": on_executors(packing.op9_packing),
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_phrases": on_executors(phrases.op11_phrases),
    "op12_variants": on_executors(variants.op12_variants),
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op1_wacz": wacz.OP1_SQL,
    "op3_chat_snapshots": chat.OP3_SQL,
    "op4_lattice": lattice.OP4_SQL,
    "op6_mixture": mixing.OP6_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_variants": variants.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
