"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .conversation_repair import op13_conversation_repair
from .embedding_dedup import op11_embedding_dedup
from .fingerprints import op7_fingerprints
from .html_extraction import op1_html_extraction
from .near_duplicates import op4_minhash_near_dedup
from .nearest import op9_nearest
from .packing import op3_packing
from .periodic_runs import op12_periodic_runs
from .quality import op6_quality_classifier
from .substring_dedup import op2_substring_dedup
from .suffix_array_dedup import op10_suffix_array_dedup
from .warc import SQL as OP5_SQL
from .warc import op5_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_nearest": op9_nearest,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL}
