"""Record schemas as DDL, declared once; readers never infer."""

from __future__ import annotations

PAPER = (
    "paper_id string, anthology_id string, corpus_key string, title string, authors array<string>, venue string, year int, track string, abstract string, doi string, url string, "
    "local_pdf_path string, source string, parser_backend string, text string, keywords array<string>, section_ids array<string>, object_ids array<string>, chunk_ids array<string>, ingested_at timestamp"
)
SECTION = (
    "section_id string, paper_id string, corpus_key string, section_title string, section_path array<string>, level int, ordinal int, page_start int, page_end int, text string, "
    "member_object_ids array<string>, member_chunk_ids array<string>, ingested_at timestamp"
)
OBJECT = (
    "object_id string, paper_id string, corpus_key string, section_id string, object_type string, ordinal int, page_idx int, bbox array<double>, text string, caption string, footnote string, html string, image_path string, ingested_at timestamp"
)
CHUNK = (
    "chunk_id string, paper_id string, corpus_key string, section_id string, chunk_type string, member_object_ids array<string>, heading string, page_start int, page_end int, char_start int, char_end int, token_count int, text string, ingested_at timestamp"
)
EVIDENCE = (
    "evidence_id string, paper_id string, evidence_type string, section_id string, heading string, page_start int, page_end int, text string, object_ids array<string>, chunk_ids array<string>"
)
FAILURE = ("paper_id string, stage string, error_type string, error_message string, failed_at timestamp")
RECORDS = {"papers": (PAPER, "paper_id"), "sections": (SECTION, "section_id"), "layout_objects": (OBJECT, "object_id"), "chunks": (CHUNK, "chunk_id"), "evidence_units": (EVIDENCE, "evidence_id")}
EVENTS = ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
