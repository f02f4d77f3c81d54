"""Schemas of the engine's tables, as DDL. ``repository_id`` is the partition column of each."""

from __future__ import annotations

from pyspark.sql import SparkSession

REPOSITORIES = (
    "id string, name string, source_type string, source_url string, branch string, commit_sha string, status string, status_detail string, error_message string, "
    "file_count int, symbol_count int, relationship_count int, languages map<string,int>, indexing_started_at timestamp_ntz, indexing_finished_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
FILES = (
    "id string, repository_id string, path string, language string, classification string, parser_capability string, content_hash string, size_bytes int, is_binary boolean, is_secret boolean, redacted boolean, created_at timestamp_ntz"
)
SYMBOLS = (
    "id string, repository_id string, file_id string, file_path string, language string, symbol_type string, symbol_name string, qualified_name string, class_name string, module_name string, "
    "start_line int, end_line int, start_column int, end_column int, code string, documentation string, parent_symbol string, content_hash string, created_at timestamp_ntz"
)
RELATIONSHIPS = (
    "id string, repository_id string, source_symbol_id string, target_symbol_id string, source_name string, target_name string, relation_type string, confidence double, evidence string, created_at timestamp_ntz"
)
CONVERSATIONS = ("id string, repository_id string, title string, created_at timestamp_ntz")
MESSAGES = ("id string, conversation_id string, repository_id string, role string, content string, citations string, created_at timestamp_ntz")

TABLES = {"repositories": REPOSITORIES, "files": FILES, "symbols": SYMBOLS, "relationships": RELATIONSHIPS, "conversations": CONVERSATIONS, "messages": MESSAGES}

# Domains of the enumerated columns.
INDEX_STATUS = ["QUEUED", "CLONING", "SCANNING", "PARSING", "EXTRACTING_SYMBOLS", "BUILDING_GRAPH", "GENERATING_EMBEDDINGS", "INDEXING", "VALIDATING", "READY", "FAILED"]
#: A run in one of these is not started again.
BUSY = ["CLONING", "PARSING", "INDEXING"]
EDGE_CONFIDENCE = {"CONTAINS": 1.0, "IMPORTS": 0.9, "CALLS": 0.55, "ROUTES_TO": 1.0}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables as Parquet, partitioned by repository, where they don't exist."""
    for name, schema in TABLES.items():
        by = "" if name == "repositories" else "PARTITIONED BY (repository_id)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet {by}")
