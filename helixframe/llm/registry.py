"""The subpackage's queries and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from helixframe.llm import ctph, decontaminate, line_dedup, merkle, packing, pii, quality, secrets, sharding, simhash, suffix_dedup, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_packing": packing.op2_packing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_fingerprints": ctph.op4_fingerprints,
    "op5_secrets": secrets.op5_secrets,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_fixity": warc.op10_fixity,
    "op11_sharding": sharding.op11_sharding,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_fixity": warc.OP10_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
