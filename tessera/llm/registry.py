"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from tessera.llm.decontamination import OP8_SQL, op8_decontamination
from tessera.llm.html_text import op4_html_text
from tessera.llm.language import op12_language
from tessera.llm.line_dedup import OP10_SQL, op10_line_dedup
from tessera.llm.minhash import OP1_SQL, op1_minhash
from tessera.llm.packing import op5_packing
from tessera.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tessera.llm.secrets import OP2_SQL, op2_secrets
from tessera.llm.token_binary import op3_token_binary
from tessera.llm.toxicity import op9_toxicity
from tessera.llm.vector_file import OP6_SQL, op6_vector_file
from tessera.llm.warc import op7_warc
from tessera.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_minhash, op2_secrets, op3_token_binary, op4_html_text, op5_packing, op6_vector_file, op7_warc, op8_decontamination, op9_toxicity, op10_line_dedup, op11_whitening, op12_language, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_secrets": OP2_SQL, "op6_vector_file": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_line_dedup": OP10_SQL, "op13_prefix_trie": OP13_SQL}
