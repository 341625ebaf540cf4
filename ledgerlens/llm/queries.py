"""The registered corpus queries and, where SQL can express one, its DuckDB twin."""

from ledgerlens.llm.decontaminate import op10_decontaminate
from ledgerlens.llm.filter_audit import op11_filter_audit
from ledgerlens.llm.filter_audit_sql import FILTER_AUDIT
from ledgerlens.llm.lm import op2_lm_score
from ledgerlens.llm.neardup import op5_near_duplicates
from ledgerlens.llm.packing import op1_pack
from ledgerlens.llm.pii import op4_pii
from ledgerlens.llm.quality import op3_quality
from ledgerlens.llm.quality_classifier import op13_quality_classifier
from ledgerlens.llm.rollup import op6_token_rollup
from ledgerlens.llm.secret_scan import op9_secrets
from ledgerlens.llm.source_audit import op12_source_divergence
from ledgerlens.llm.source_audit_sql import SOURCE_AUDIT
from ledgerlens.llm.toxicity import op7_toxicity
from ledgerlens.llm.url_sql import URL_FILTER
from ledgerlens.llm.urls import op8_url_filter

QUERIES = {
    "op1_pack": op1_pack,
    "op2_lm_score": op2_lm_score,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_rollup": op6_token_rollup,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_classifier": op13_quality_classifier,
}

#: The others learn models, sketch or tokenise; tests/llm holds them against brute force.
ORACLE = {"op8_url_filter": URL_FILTER, "op11_filter_audit": FILTER_AUDIT, "op12_source_divergence": SOURCE_AUDIT}
