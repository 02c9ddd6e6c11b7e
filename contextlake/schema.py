"""Schemas of the stored tables."""

from __future__ import annotations

SCHEMA_VERSION = 3

TABLES = {
    "files": "file_id long, path string, hash string, language string, size_bytes long, chunk_count int, indexed_at timestamp, modified_at timestamp",
    "chunks": "chunk_id long, file_id long, chunk_type string, name string, start_line int, end_line int, content string, token_count long, search_text string, created_at timestamp",
    "dependencies": "source_file_id long, target_path string, target_file_id long, dep_type string",
    "access_log": "access_id long, file_id long, query string, accessed_at timestamp",
    "vec_chunks": "chunk_id long, embedding array<float>, model string",
}
HISTORY = "seq long, query string, timestamp timestamp, result_count long"
