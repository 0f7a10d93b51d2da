"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quillspark.llm.ann import op4_ann_search
from quillspark.llm.audit import OP12_SQL, op12_filter_audit
from quillspark.llm.centroids import OP11_SQL, op11_centroid_clustering
from quillspark.llm.decontaminate import op9_decontamination
from quillspark.llm.licenses import op2_license_scan
from quillspark.llm.lines import OP13_SQL, op13_line_dedup
from quillspark.llm.near import op8_jaccard_join
from quillspark.llm.packing import op3_best_fit_packing
from quillspark.llm.quality import op10_quality_classifier
from quillspark.llm.secrets import op7_secret_scan
from quillspark.llm.suffixes import op6_suffix_dedup
from quillspark.llm.tokens import op1_token_counts
from quillspark.llm.toolcalls import OP5_SQL, op5_tool_calls

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ann_search": op4_ann_search,
    "op5_tool_calls": op5_tool_calls,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op5_tool_calls": OP5_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
