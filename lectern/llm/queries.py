"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from lectern.llm.ann import op2_nearest
from lectern.llm.codes import CODES_SQL, op12_codes
from lectern.llm.conversations import CONVERSATIONS_SQL, op11_conversations
from lectern.llm.embedding_dedup import VECTORS_SQL, op7_embedding_dedup
from lectern.llm.licences import op13_licences
from lectern.llm.minhash import MINHASH_SQL, op4_minhash
from lectern.llm.mixing import MIX_SQL, op10_mix
from lectern.llm.packing import op1_best_fit_packing
from lectern.llm.pii import op3_pii
from lectern.llm.suffixes import STRINGS_SQL, op9_suffix_array
from lectern.llm.tokens import op5_token_counts
from lectern.llm.toxicity import op6_toxicity
from lectern.llm.warc import WARC_SQL, op8_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_nearest": op2_nearest,
    "op3_pii": op3_pii,
    "op4_minhash": op4_minhash,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_warc": op8_warc,
    "op9_suffix_array": op9_suffix_array,
    "op10_mix": op10_mix,
    "op11_conversations": op11_conversations,
    "op12_codes": op12_codes,
    "op13_licences": op13_licences,
}

ORACLES = {
    "op4_minhash": MINHASH_SQL,
    "op7_embedding_dedup": VECTORS_SQL,
    "op8_warc": WARC_SQL,
    "op9_suffix_array": STRINGS_SQL,
    "op10_mix": MIX_SQL,
    "op11_conversations": CONVERSATIONS_SQL,
    "op12_codes": CODES_SQL,
}
