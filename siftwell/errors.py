"""Errors of the engine and the limits its inputs must keep."""

from __future__ import annotations

#: Error codes.
CODES = ["invalid_argument", "not_found", "already_exists", "corrupt_index", "io_error", "unavailable", "unsupported", "resource_exhausted", "cancelled", "dimension_mismatch", "internal"]

#: Limits of the service surface.
MAX_TAGS, MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_TAG_BYTES = 64, 128, 4096, 64 * 1024
MAX_FILTER_VALUES_PER_KEY, MAX_FILTER_VALUES = 256, 1024
MAX_TOP_K = 100


class EngineError(Exception):
    """An error with one of ``CODES``."""

    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code
