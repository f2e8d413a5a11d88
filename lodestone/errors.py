"""Stable error codes of the form ``area.detail``."""

from __future__ import annotations

from dataclasses import dataclass

READER_NOT_FOUND = "reader.not_found"
READER_PERMISSION = "reader.permission"
READER_PARSE = "reader.parse"
READER_ENCODING = "reader.encoding"
READER_UNSUPPORTED = "reader.unsupported"
READER_TOO_LARGE = "reader.too_large"
PERSIST_EMBED_FAILED = "ingest.persist.embed_failed"
PERSIST_INSERT_FAILED = "ingest.persist.insert_failed"
DATASET_MISSING = "dataset.missing"
SEARCH_INVALID = "search.invalid_request"


@dataclass
class EngineError(Exception):
    code: str
    message: str

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"
