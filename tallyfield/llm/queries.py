"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontaminate import OP2_SQL, op2_decontaminate
from .language_id import op13_language_id
from .lexical_search import OP12_SQL, op12_lexical_search
from .line_dedup import OP9_SQL, op9_line_dedup
from .pii import op8_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .sharding import op3_sharding
from .simhash import op5_simhash
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_array import OP6_SQL, op6_suffix_array

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_decontaminate, op3_sharding, op4_substring_dedup, op5_simhash, op6_suffix_array,
        op7_quality_rules, op8_pii, op9_line_dedup, op10_quality_classifier, op11_prefix_trie, op12_lexical_search, op13_language_id,
    )
}

SQL = {
    "op2_decontaminate": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_suffix_array": OP6_SQL, "op9_line_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL,
}
