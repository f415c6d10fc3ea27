"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from .ann import op7_query
from .decontaminate import op4_query
from .html_text import op5_query
from .line_dedup import op3_query
from .mixing import op8_query
from .part_codes import op11_query
from .quality import op9_query
from .sharding import op6_query
from .simhash import op2_query
from .toxicity import op1_query
from .url_reputation import OP10_SQL, op10_query
from .weak_rules import op12_query
from .whitening import op13_query

QUERIES = {
    "op1_subsequence_toxicity": op1_query,
    "op2_simhash_neardup": op2_query,
    "op3_fuzzy_lines": op3_query,
    "op4_benchmark_leaks": op4_query,
    "op5_mincut_main_text": op5_query,
    "op6_flow_reshard": op6_query,
    "op7_multi_index_hashing": op7_query,
    "op8_golden_mix": op8_query,
    "op9_quality_ranking": op9_query,
    "op10_host_reputation": op10_query,
    "op11_part_codes": op11_query,
    "op12_weak_rules": op12_query,
    "op13_jacobi_whitening": op13_query,
}

ORACLE: dict[str, str] = {
    "op10_host_reputation": OP10_SQL,
}
