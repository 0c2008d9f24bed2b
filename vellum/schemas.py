"""Schemas of the tables that the pipeline writes."""

from __future__ import annotations

TABLES = {
    "sync_batches": "batch_code string, data_type string, ftp_folder string, status string, total_files int, processed_files int, total_patents int, imported_patents int, error_message string, started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz",
    "sync_logs": "id long, batch_code string, level string, message string, details string, created_at timestamp_ntz",
    "patent": "id string, doc_number string, kind string, pub_country string, pub_date string, app_number string, app_date string, app_country string, app_type string, title string, abstract string, description string, claims string, status string, lang string, abstract_fig_key string, batch_id string, source_file string, grant_number string, grant_date string, priority_info string, claim_count int, independent_claim_count int, raw_xml string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "patent_applicant": "patent_id string, name string, address string, province string, city string, county string, postcode string, country string",
    "patent_assignee": "patent_id string, name string, address string, province string, city string, postcode string, country string",
    "patent_inventor": "patent_id string, name string",
    "patent_examiner": "patent_id string, name string",
    "patent_agent": "patent_id string, agency string, agent string",
    "patent_ipc": "patent_id string, ipc_code string, code_norm string",
    "patent_citation": "patent_id string, country string, doc_number string, kind string, pub_date date",
    "patent_claim": "patent_id string, claim_num int, claim_text string, is_independent boolean",
    "image_asset": "id string, oss_key string, content_hash string, perceptual_hash string, content_type string, size int, width int, height int, created_at timestamp_ntz",
    "patent_image": "patent_id string, asset_id string, file_name string, is_abstract boolean, image_role string, figure_label string, source_section string, display_rotation int, match_method string, match_score double, matched_file_name string, sort_order int",
    "classification": "code_norm string, code string, source_code string, version string, section string, class_code string, subclass string, main_group string, subgroup string, level int, title_en string, title_zh string, title_zh_source string, source_file string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "classification_embedding": "type string, code_norm string, version string, locale string, embedding_model string, embedding_dimensions int, content_hash string, content string, embedding array<double>, embedded_at timestamp_ntz",
}

#: Child tables of ``patent``.
CHILDREN = [t for t in TABLES if t.startswith("patent_")]

#: Columns of ``patent`` that an update of a known patent takes over; ``description`` only if there is a new one.
UPDATED = ["title", "abstract", "description", "claims", "lang", "abstract_fig_key", "batch_id", "source_file", "grant_number", "grant_date", "claim_count", "independent_claim_count", "updated_at"]
UPDATED_IF_PRESENT = ["description"]
