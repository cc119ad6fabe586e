"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from lamina.llm import licences, phrases, repeats, sharding
from lamina.llm.bpe import op1_byte_bpe
from lamina.llm.fingerprints import op8_fingerprints
from lamina.llm.gif import op4_gif
from lamina.llm.language import op6_language_id
from lamina.llm.near_dedup import op9_near_dedup
from lamina.llm.packing import op3_packing
from lamina.llm.quality import op5_quality
from lamina.llm.repair import op13_conversation_repair
from lamina.llm.secrets import op7_secrets

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_licences": licences.op2_licences,
    "op3_packing": op3_packing,
    "op4_gif": op4_gif,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_secrets": op7_secrets,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_phrases": phrases.op11_phrases,
    "op12_substring_dedup": repeats.op12_substring_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The others have no SQL; tests hold them against brute force, exact round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op2_licences": licences.ORACLE,
    "op10_sharding": sharding.oracle(),
    "op11_phrases": phrases.oracle(),
    "op12_substring_dedup": repeats.ORACLE,
}
