"""Schemas of the note collection's tables."""

from __future__ import annotations

#: DDL by table name; readers take it as it is.
SCHEMAS = {
    "notes": "note_id long, title string, content string, content_hash string, parent_note_id long, path_cached string, sort_order int, icon string, "
    "indexing_status string, indexing_error string, indexed_at long, embedding_model string, embedding_dimension int, indexing_version string, "
    "lifecycle string, is_pinned boolean, is_favorite boolean, mastery double, last_studied long, created_at long, updated_at long",
    "fragments": "fragment_id long, note_id long, order_index long, raw_text string, raw_text_hash string, clean_text string, clean_text_hash string, created_at long, updated_at long",
    "fragment_embeddings": "fragment_id long, embedding_model string, embedding_model_version string, dim int, embedding array<float>, embedded_at long",
    "embedding_cache": "clean_text_hash string, embedding_model string, embedding_model_version string, dim int, embedding array<float>, created_at long",
    "cards": "card_id long, note_id long, section_id long, card_type string, custom_front string, custom_back string, cloze_mask string, status string, "
    "last_section_snapshot string, generated_by string, source_raw_hash_at_creation string, created_at long, updated_at long",
    "schedules": "schedule_id long, target_type string, target_id long, state string, stability double, difficulty double, elapsed_days int, "
    "scheduled_days int, reps long, lapses long, last_reviewed long, next_review long",
    "note_revisions": "revision_id long, note_id long, patch string, created_at long",
    "distribution_runs": "run_id long, draft_id long, plan_json string, result_json string, generator_version string, status string, created_at long, applied_at long",
    "review_logs": "log_id long, schedule_id long, rating int, reviewed_at long, prev_state string, prev_stability double, prev_difficulty double, elapsed_days int",
    "tags": "tag_id long, parent_tag_id long, name string, slug string, color string, icon string, depth int, path_cached string, description string, created_at long, updated_at long",
    "tag_closure": "ancestor_id long, descendant_id long, depth int",
    "note_tags": "note_id long, tag_id long, source string, confidence double, created_at long",
    "fragment_tags": "fragment_id long, tag_id long, source string, created_at long",
    "retrieval_calibration": "calibration_id long, query string, expected_note_title string, relevance_weight double",
    "llm_cache": "query string, model_id string, cache_type string, target_lang string, cached_response string, created_at long",
    "meta": "key string, value string",
}
