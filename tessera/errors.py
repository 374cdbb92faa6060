"""Errors with a stable code and an exit status."""

from __future__ import annotations

#: Exit status of each error code (fixed values).
EXIT_STATUS = {
    "INVALID_ARGUMENT": 2, "INVALID_DECLARATION": 2, "REQUEST_MISMATCH": 2, "BUILD_INCOMPLETE": 2, "UNSUPPORTED_CAPABILITY": 2,
    "ENGINE_BUSY": 3, "STATE_CONFLICT": 3, "OWNERSHIP_LOST": 3, "NOT_FOUND": 4, "UNAVAILABLE": 4, "INTEGRITY_FAILURE": 5, "PROTOCOL_FAILURE": 5,
    "BACKEND_FAILURE": 6, "ENGINE_FAILURE": 6, "OUTCOME_UNKNOWN": 6, "EXTRACTION_INCOMPLETE": 6, "ADAPTER_FAILURE": 6,
}


class TesseraError(Exception):
    """An error of the engine; `code` is one of EXIT_STATUS."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code

    @property
    def exit_status(self) -> int:
        return EXIT_STATUS[self.code]
