"""The queries of this subpackage, by name."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .html import op5_html
from .katz import op9_katz
from .langid import op4_langid
from .neighbours import op11_quality_votes
from .neardup import op3_neardup
from .packing import op8_packing
from .pii import op2_pii
from .quality import op7_quality
from .sharding import op6_sharding
from .spelling import op13_spelling
from .trie import TRIE_SQL, op12_trie
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_neardup": op3_neardup,
    "op4_langid": op4_langid,
    "op5_html": op5_html,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_katz": op9_katz,
    "op10_decontaminate": op10_decontaminate,
    "op11_quality_votes": op11_quality_votes,
    "op12_trie": op12_trie,
    "op13_spelling": op13_spelling,
}
#: DuckDB twins; queries without one are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op12_trie": TRIE_SQL}
