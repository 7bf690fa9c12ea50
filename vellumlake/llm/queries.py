"""The numbered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .decontamination import op9_benchmark_decontamination
from .fingerprints import op1_document_fingerprints
from .html_extraction import op6_html_extraction
from .license_scan import op8_license_scans
from .lm_scoring import op4_lm_scoring
from .merkle import SQL as OP13_SQL
from .merkle import op13_merkle_manifest
from .ngram_join import SQL as OP2_SQL
from .ngram_join import op2_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .phrases import SQL as OP11_SQL
from .phrases import op11_phrase_collocations
from .pii import op12_personal_data
from .secrets import op3_secret_scans
from .suffix_dedup import op5_suffix_array_dedup
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_ngram_jaccard_join, op3_secret_scans, op4_lm_scoring, op5_suffix_array_dedup, op6_html_extraction, op7_toxicity, op8_license_scans, op9_benchmark_decontamination, op10_best_fit_packing, op11_phrase_collocations, op12_personal_data, op13_merkle_manifest)}

SQL: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op11_phrase_collocations": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
