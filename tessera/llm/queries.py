"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.byte_pairs import op11_byte_pairs
from tessera.llm.decontaminate import op4_decontamination
from tessera.llm.jaccard import op3_jaccard_join
from tessera.llm.lattice import op7_lattice_likelihood
from tessera.llm.near_vectors import OP2_SQL, op2_near_vectors
from tessera.llm.oracles import OP3_SQL, OP4_SQL, OP12_SQL
from tessera.llm.packing import op8_best_fit_packing
from tessera.llm.resampling import op1_importance_resampling
from tessera.llm.search import op12_ranked_search
from tessera.llm.secrets import op10_secret_scans
from tessera.llm.spelling import op13_spelling_variants
from tessera.llm.token_counts import op9_token_counts
from tessera.llm.token_files import op6_token_files
from tessera.llm.urls import op5_url_filters

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_near_vectors": op2_near_vectors,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_token_files": op6_token_files,
    "op7_lattice_likelihood": op7_lattice_likelihood,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scans": op10_secret_scans,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_vectors": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op12_ranked_search": OP12_SQL,
}
