"""Schemas (as DDL) of the tables that the pipelines read and write."""

from __future__ import annotations

FILES = (
    "repository string, path string, source string, license string, language string, hash string, size bigint, "
    "quality_score double, file_quality double, split string, created_at string, drop_reason string, content string"
)
SIGNALS = "struct<syntax_validity: double, documentation: double, tests: double, structure: double, comments: double, complexity: double, maintainability: double, duplicate_ratio: double>"
REPOS = (
    f"repository string, source string, license string, quality_score double, n_files bigint, n_bytes bigint, languages map<string, bigint>, split string, signals {SIGNALS}, created_at string"
)
TASKS = ("task string, input string, target string, text string, language string, repository string, path string, split string, license string")
SOURCES = ("id string, kind string, location string, license_hint string, languages array<string>, category string, ref string, subpath string, enabled boolean")
SOURCE_KINDS = ("huggingface", "github", "http", "local")
SOURCE_CATEGORIES = ("code", "docs", "tests", "examples", "tutorial", "markdown")
SOURCE_FIELDS = ("id", "kind", "location", "license_hint", "languages", "category", "ref", "subpath", "enabled")
