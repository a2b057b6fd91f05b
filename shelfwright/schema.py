"""Schemas of the engine's tables."""

FILES = "seq long, id string, path string, size long, mtime double, type string, hash string"
SNIPPETS = "id string, text string"
NODE_META = "struct<file_ids: array<string>, hash: string, bucket: string, summary: string, subcount: long, size: long, mtime: double, type: string>"
NODES = f"id string, kind string, label string, meta {NODE_META}, reasoning struct<rationale: string, confidence: double>"
EDGES = "id string, source string, target string, kind string"
MOVES = "id string, `from` string, `to` string, reason string"
DELETES = "id string, path string, reason string, confidence double"
PLAN = f"summary struct<files_scanned: long, duplicate_clusters: long, near_duplicate_clusters: long, image_similarity_clusters: long, suggested_deletions: long, suggested_moves: long, elapsed_sec: double, storage_rate_per_gb: double>, moves array<struct<id: string, `from`: string, `to`: string, reason: string>>, deletes array<struct<id: string, path: string, reason: string, confidence: double>>, cluster_costs map<string, struct<bytes: long, gb: double, monthly_cost: double>>"
CATEGORIES = "bucket string, label string, file_ids array<string>, rationale string, confidence double"
