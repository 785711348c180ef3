"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .decontaminate import op10_decontaminate
from .fingerprint import op2_fingerprints
from .html_text import OP11_SQL, op11_html_text
from .language_id import op6_language_id
from .license_scan import op5_license_scan
from .license_scan import sql as op5_sql
from .lm_score import op8_lm_score
from .merkle import OP12_SQL, op12_merkle_manifest
from .near_dedup import OP9_SQL, op9_near_dedup
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op7_quality
from .token_counts import op1_token_counts
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_url_filter, op4_byte_bpe, op5_license_scan, op6_language_id, op7_quality, op8_lm_score, op9_near_dedup, op10_decontaminate, op11_html_text, op12_merkle_manifest, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op5_license_scan": op5_sql(), "op9_near_dedup": OP9_SQL, "op11_html_text": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_prefix_trie": OP13_SQL}
