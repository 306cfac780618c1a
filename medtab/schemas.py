"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

PAGES = "doc_id string, page int, text string, fmt string, extractor string, success boolean, n_images int, errors array<string>"
WORDS = "doc_id string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
SECTIONS = "doc_id string, page int, section_no int, title string, text string"
TABLE_ROWS = ("doc_id string, page int, table_no int, row_no int, title string, headers array<string>, cells array<string>, "
              "name string, value string, unit string, reference_range string, extra map<string,string>")
MEASUREMENTS = "doc_id string, page int, name string, value string, unit string, reference_range string, source_section string"
CONCEPTS = ("doc_id string, concept_no int, concept string, original_text string, type string, semantic_category string, value_raw string, "
            "value_num double, unit string, reference_range string, assertion string, modifiers map<string,string>, related_anatomy array<string>")
MENTIONS = "doc_id string, term string, report_type string, section_title string, source_text string, anatomy array<string>, measurements array<string>"
SIGNATURES = "report_type string, registry_no int, role string, group_no int, position int, pattern string, weight double, category string"
TERMINOLOGY = "surface_form string, candidate string, domain string, is_safety boolean, line_no int"
RANGES = "code string, gender string, category string, interval_no int, low double, high double, unit string"

#: Values that enumerated columns may hold.
ENUMS = {
    "assertion": ["PRESENT", "ABSENT", "POSSIBLE", "NORMAL", "HISTORICAL", "UNKNOWN"],
    "comparison": ["WITHIN_REPORTED_RANGE", "ABOVE_REPORTED_REFERENCE_RANGE", "BELOW_REPORTED_REFERENCE_RANGE", "NO_REFERENCE_RANGE_SUPPLIED"],
    "significance": ["INFORMATIONAL", "WITHIN_REPORTED_RANGE", "OUTSIDE_REPORTED_RANGE", "NOTABLE_FINDING", "REQUIRES_CONTEXT", "UNRESOLVED", "CRITICAL"],
    "alert_level": ["GREEN", "YELLOW", "ORANGE", "RED", "GREY"],
    "quality": ["GOOD", "DEGRADED", "FAILED"],
}
