"""Queries and SQL of this subpackage."""

from docgrid.llm import context_tree, decontamination, language, merkle, minhash, mixing, near_vectors, nearest, packing, quality, repair, secrets, tokens

QUERIES = {
    "op1_near_vectors": near_vectors.op1_near_vectors,
    "op2_secrets": secrets.op2_secrets,
    "secrets_known_patterns": secrets.known_patterns_query,
    "op3_minhash": minhash.op3_minhash,
    "op4_tokens": tokens.op4_tokens,
    "op5_nearest": nearest.op5_nearest,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "mixing_training_order": mixing.training_order_query,
    "op8_context_tree": context_tree.op8_context_tree,
    "op9_language": language.op9_language,
    "op10_quality": quality.op10_quality,
    "op11_repair": repair.op11_repair,
    "op12_merkle": merkle.op12_merkle,
    "op13_decontamination": decontamination.op13_decontamination,
}
ORACLES = {
    "op1_near_vectors": near_vectors.OP1_SQL,
    "secrets_known_patterns": secrets.PATTERNS_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op5_nearest": nearest.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_repair": repair.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
