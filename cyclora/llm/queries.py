"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import block_naming, byte_bpe, crf_quality, lsh_forest, mixing, personal_data, quality_rules, secrets, sharding, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_crf_quality": crf_quality.op2_crf_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_block_naming": block_naming.op4_block_naming,
    "op5_lsh_forest": lsh_forest.op5_lsh_forest,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_personal_data": personal_data.op9_personal_data,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_block_naming": block_naming.OP4_SQL,
    "op5_lsh_forest": lsh_forest.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
}
