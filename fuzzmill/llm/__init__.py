"""Training-data operators: one module each, and their registered queries."""

from __future__ import annotations

from .bpe import op3_sentencepiece_round_trip
from .chat import OP2_SQL, op2_chat_formatting
from .decontam import OP7_SQL, op7_benchmark_decontamination
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .html_text import op11_html_extraction
from .langid import op6_language_id
from .licenses import op8_license_scan
from .periodic import op13_periodic_runs
from .quality import op1_quality_classifier
from .simhash import op10_simhash_near_dedup
from .token_counts import op5_token_counts
from .toxicity import op4_toxicity
from .vector_codes import op12_vector_codes

_ALL = (
    op1_quality_classifier,
    op2_chat_formatting,
    op3_sentencepiece_round_trip,
    op4_toxicity,
    op5_token_counts,
    op6_language_id,
    op7_benchmark_decontamination,
    op8_license_scan,
    op9_exact_dedup,
    op10_simhash_near_dedup,
    op11_html_extraction,
    op12_vector_codes,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op2_chat_formatting": OP2_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
}
