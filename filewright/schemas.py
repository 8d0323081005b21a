"""Schemas of the stored tables, as DDL. The column names are fixed values."""

FILES = (
    "run_id STRING, document_id STRING, source_path STRING, filename STRING, extension STRING,"
    " mime_type STRING, file_hash STRING, file_size BIGINT, extracted_text STRING,"
    " metadata MAP<STRING,STRING>, ocr_used BOOLEAN, conversion_used BOOLEAN, errors ARRAY<STRING>"
)

EVENTS = (
    "event_id BIGINT, run_id STRING, document_id STRING, source_path STRING, destination_path STRING,"
    " filename STRING, status STRING, category_l1 STRING, category_l2 STRING, confidence DOUBLE,"
    " reason STRING, needs_review BOOLEAN, file_hash STRING, prompt_version STRING,"
    " understanding_model STRING, classification_model STRING, ocr_used BOOLEAN,"
    " conversion_used BOOLEAN, dry_run BOOLEAN, error_message STRING, created_at TIMESTAMP"
)

RUN_RECORDS = (
    "run_id STRING, seq INT, started_at TIMESTAMP, completed_at TIMESTAMP, dry_run BOOLEAN,"
    " total_files BIGINT, processed_files BIGINT, failed_files BIGINT, review_files BIGINT,"
    " avg_confidence DOUBLE"
)

DECISIONS = (
    "file_hash STRING, prompt_version STRING, understanding_model STRING, classification_model STRING,"
    " summary STRING, keywords ARRAY<STRING>, language STRING, document_type STRING,"
    " category_l1 STRING, category_l2 STRING, confidence DOUBLE, reason STRING,"
    " needs_review BOOLEAN, cached_at TIMESTAMP"
)

EXTRACTIONS = (
    "file_hash STRING, ocr_model STRING, extracted_text STRING, metadata MAP<STRING,STRING>,"
    " extraction_quality DOUBLE, ocr_used BOOLEAN, conversion_used BOOLEAN, cached_at TIMESTAMP"
)

PRECOMPUTED = "source_path STRING, text STRING"

RESPONSES = "document_id STRING, stage STRING, raw STRING"

TAXONOMY = "category_l1 STRING, category_l2 STRING"

LABELS = (
    "source_path STRING, expected_category_l1 STRING, expected_category_l2 STRING,"
    " expected_needs_review BOOLEAN"
)

MOVEMENTS = (
    "id BIGINT, original_path STRING, original_filename STRING, new_path STRING, new_filename STRING,"
    " category STRING, processed_date TIMESTAMP, file_hash STRING, file_size BIGINT,"
    " extraction_method STRING, cached BOOLEAN, processing_time_seconds DOUBLE, error_message STRING"
)
