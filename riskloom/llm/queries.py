"""The queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from riskloom.llm.decontaminate import op2_decontamination
from riskloom.llm.licenses import op10_licenses
from riskloom.llm.mixing import OP4_SQL, op4_mixing
from riskloom.llm.neardup import OP5_SQL, op5_neardup
from riskloom.llm.packing import op13_packing
from riskloom.llm.quality import op7_quality
from riskloom.llm.sharding import OP8_SQL, op8_sharding
from riskloom.llm.suffixes import OP3_SQL, op3_suffixes
from riskloom.llm.tokens import op1_tokens
from riskloom.llm.trie import OP11_SQL, op11_trie
from riskloom.llm.vectors import OP9_SQL, op9_vectors
from riskloom.llm.warc import OP6_SQL, op6_warc
from riskloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_decontamination": op2_decontamination,
    "op3_suffixes": op3_suffixes,
    "op4_mixing": op4_mixing,
    "op5_neardup": op5_neardup,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_vectors": op9_vectors,
    "op10_licenses": op10_licenses,
    "op11_trie": op11_trie,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffixes": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op5_neardup": OP5_SQL,
    "op8_sharding": OP8_SQL,
    "op6_warc": OP6_SQL,
    "op9_vectors": OP9_SQL,
    "op11_trie": OP11_SQL,
}
