"""Queries of this folder and, where SQL can express them, their DuckDB texts."""

from pointloom.llm import mixing, near, quality, urls
from pointloom.llm.ann import op5_nearest
from pointloom.llm.html import op3_html_extraction
from pointloom.llm.langid import op2_language_id
from pointloom.llm.licenses import op6_license_scan
from pointloom.llm.mixing import op8_mixing
from pointloom.llm.near import op9_jaccard_join
from pointloom.llm.packing import op4_packing
from pointloom.llm.pii import op10_pii
from pointloom.llm.quality import op1_quality_rules
from pointloom.llm.urls import op7_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_nearest": op5_nearest,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op7_url_filter": urls.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_jaccard_join": near.ORACLE,
}
