"""Schemas of the archive's tables, for readers that must not infer them."""

from __future__ import annotations

SCREENSHOTS = "id long, image_path string, image_hash string, window_title string, process_name string, created_at timestamp, category string, category_confidence double, page_url string, page_icon string, page_icon_id long, visible_links string, link_set_id long, width int, height int, status string, is_deleted boolean"
OCR_RESULTS = "id long, screenshot_id long, text string, confidence double, box array<array<double>>, text_hash string, is_deleted boolean"
EMBEDDINGS = "index_kind string, subject_key string, vector array<float>, model_id string, model_revision string, embedding_version int, source_fingerprint string, created_at timestamp"
JOBS = "index_kind string, subject_key string, model_id string, model_revision string, embedding_version int, source_fingerprint string, status string, attempts int, next_retry_at timestamp, updated_at timestamp, lease_token string"
TASKS = "id long, label string, layer string, category string, start_time double, end_time double, screenshot_count long"
TASK_ASSIGNMENTS = "screenshot_id long, task_id long, confidence double"
CLUSTERS = "id long, title string, anchor_text string, threshold double, enabled boolean, updated_at timestamp"
CLUSTER_ASSIGNMENTS = "cluster_id long, screenshot_id long, rerank_score double"
EVENT_LOG = "pid long, process string, path string, operation string, bytes long, ts timestamp"
