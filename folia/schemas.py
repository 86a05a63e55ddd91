"""Names and types of the engine's tables."""

from __future__ import annotations

MAIN_STRATEGY, BASELINE_STRATEGY = "text_first_with_visual_support", "llm_ready_native"
TEXT_TYPES, VISUAL_TYPES, TABLE_TYPES = ("title", "text"), ("chart", "image"), ("table",)
EXCLUDED_ROLES = ("footer", "page_number", "decorative_noise")
EXCLUDED_KINDS = ("decorative_visual", "background", "logo")

#: The block table. Further meta fields of a source travel in ``meta_other`` as JSON.
BLOCKS = """
    doc_id string, page_num int, seq int, block_id string, type string, bbox array<double>, text string, source string, score double,
    summary_role string, slide_role string, dashboard_role string, panel_kind string, visual_role string, summary_exclude boolean, rag_exclude boolean, exclude_reason string,
    summary_priority string, rag_order int, panel_order int, reading_order int, panel_id string, region_id string, dashboard_region_id string,
    associated_title string, meta_page_title string, table_summary string, table_markdown string, chart_summary string, visual_summary string, caption_text string,
    key_value_rows array<struct<item: string, `values`: string>>, context_ids array<string>, meta_other string
"""
PAGES = "doc_id string, page_num int, page_title string, text string, rag_text string, page_width double, page_height double, text_source string"
DOCUMENTS = "doc_id string, filename string, filepath string, document_type string, refined_type string, pipeline_used string, quality_grade string"

# The metadata contract: fixed names by type class.
STRING_FIELDS = (
    "chunk_id", "strategy_name", "doc_id", "filename", "filepath", "document_type", "pipeline_used", "quality_grade", "chunk_type", "section_title", "page_title", "associated_title",
    "chosen_text_source", "summary_priority", "retrieval_text", "display_text", "evidence_preview", "evidence_image_path", "visual_type", "source_bbox", "extraction_method",
)
BOOL_FIELDS = ("has_text", "has_table", "has_chart", "has_image")
INT_FIELDS = ("page_num", "chunk_index", "table_count", "image_count", "char_len", "token_estimate", "visual_index")
FLOAT_FIELDS = ("visual_confidence",)
METADATA_FIELDS = ("vector_record_id", *STRING_FIELDS, "source_block_ids", *BOOL_FIELDS, *INT_FIELDS, *FLOAT_FIELDS)
