"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_bpe
from .decontamination import OP5_SQL, op5_decontamination
from .jaccard import op7_jaccard
from .quality import OP3_SQL, op3_quality_rules
from .search import OP13_SQL, op13_search
from .secrets import op2_secret_scan
from .sharding import op8_sharding
from .simhash import op11_simhash
from .spelling import OP12_SQL, op12_spelling
from .suffix_array import OP4_SQL, op4_suffix_array
from .suffix_tree import OP6_SQL, op6_suffix_tree
from .tokenfiles import op10_token_files
from .toxicity import op1_toxicity

QUERIES = {
    "op7_jaccard": op7_jaccard,
    "op6_suffix_tree": op6_suffix_tree,
    "op4_suffix_array": op4_suffix_array,
    "op10_token_files": op10_token_files,
    "op5_decontamination": op5_decontamination,
    "op1_toxicity": op1_toxicity,
    "op9_bpe": op9_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op8_sharding": op8_sharding,
    "op11_simhash": op11_simhash,
    "op12_spelling": op12_spelling,
    "op13_search": op13_search,
}

SQL = {"op4_suffix_array": OP4_SQL, "op6_suffix_tree": OP6_SQL, "op5_decontamination": OP5_SQL, "op3_quality_rules": OP3_SQL, "op12_spelling": OP12_SQL, "op13_search": OP13_SQL}
