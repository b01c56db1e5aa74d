"""The registered queries of this subpackage."""

from __future__ import annotations

from leakdrift.llm.extraction import op2_html_extraction
from leakdrift.llm.formatting import op3_chat_format
from leakdrift.llm.licenses import op1_license_scan
from leakdrift.llm.lines import op10_line_dedup
from leakdrift.llm.manifest import op11_merkle_manifest
from leakdrift.llm.mixing import op4_mix
from leakdrift.llm.neardup import op6_minhash_near_dedup
from leakdrift.llm.packing import op9_best_fit_packing
from leakdrift.llm.periods import op12_periodic_runs
from leakdrift.llm.quality import op8_quality_rules
from leakdrift.llm.tokens import op13_token_counts
from leakdrift.llm.toxicity import op5_toxicity
from leakdrift.llm.vectors import op7_embedding_near_dedup

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_chat_format": op3_chat_format,
    "op4_mix": op4_mix,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {}
