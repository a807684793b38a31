"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from . import decontam, exact, lines, neardup, packing, quality, secrets, shards, tokenfiles, toxicity

QUERIES = {
    "op1_hierarchical_packing": packing.op1_hierarchical_packing,
    "op2_hash_tree_shards": shards.op2_hash_tree_shards,
    "op3_latent_votes": quality.op3_latent_votes,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_blob_ledger": secrets.op5_blob_ledger,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_winnowing": decontam.op7_winnowing,
    "op8_kneser_ney": toxicity.op8_kneser_ney,
    "op9_circulant_minhash": neardup.op9_circulant_minhash,
    "op10_line_dedup": lines.op10_line_dedup,
}

ORACLES = {
    "op6_exact_dedup": exact.OP6_SQL,
    "op10_line_dedup": lines.OP10_SQL,
}
