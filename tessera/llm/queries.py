"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .conversation_repair import op11_conversation_repair
from .fingerprint import op10_fingerprints
from .language import op7_language_id
from .language_model import op4_lm_scoring
from .licenses import op1_license_scans
from .main_text import op12_html_extraction
from .near_duplicates import op8_ngram_jaccard_join
from .oracles import ORACLES
from .packing import op3_best_fit_packing
from .pieces import op9_sentencepiece
from .prefix_trie import op13_prefix_trie
from .quality import op5_quality_rules
from .substrings import op6_suffix_array_dedup
from .tokens import op2_token_counts

QUERIES = {f.__name__: f for f in (
    op1_license_scans, op2_token_counts, op3_best_fit_packing, op4_lm_scoring, op5_quality_rules, op6_suffix_array_dedup,
    op7_language_id, op8_ngram_jaccard_join, op9_sentencepiece, op10_fingerprints,
    op11_conversation_repair, op12_html_extraction, op13_prefix_trie)}
