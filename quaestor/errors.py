"""Errors and query outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QuaestorError(Exception):
    """Base of all errors; ``code`` names the kind, ``details`` what it was about."""

    code = "UNKNOWN_ERR"

    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.message, self.details = message, details

    def __str__(self) -> str:
        return f"[{self.code}] {self.message}"


def _kind(name: str, code: str, base: type = QuaestorError) -> type:
    return type(name, (base,), {"code": code, "__module__": __name__})


DataLoadError = _kind("DataLoadError", "DATA_LOAD_ERR")
ModelError = _kind("ModelError", "MODEL_ERR")
ModelConnectionError = _kind("ModelConnectionError", "MODEL_CONN_ERR", ModelError)
ModelTimeoutError = _kind("ModelTimeoutError", "MODEL_TIMEOUT", ModelError)
ModelResponseError = _kind("ModelResponseError", "MODEL_RESP_ERR", ModelError)
ModelNotFoundError = _kind("ModelNotFoundError", "MODEL_404", ModelError)
QueryError = _kind("QueryError", "QUERY_ERR")
StructuredQueryError = _kind("StructuredQueryError", "STRUCT_QUERY_ERR", QueryError)
VectorSearchError = _kind("VectorSearchError", "VECTOR_SEARCH_ERR", QueryError)
HybridError = _kind("HybridError", "HYBRID_ENGINE_ERR", QueryError)
MemoryError_ = _kind("MemoryError_", "CTX_MEMORY_ERR")

QUERY_MESSAGES = {
    "NO_MATCH": "The question matches no pattern that I know.",
    "NO_CONTEXT": "Nothing in the data relates to the question.",
    "AMBIGUOUS_QUERY": "The question can be read in more than one way.",
    "EMPTY_RESULT": "No rows match.",
    "ALL_ENGINES_FAILED": "No engine could answer the question.",
}


@dataclass
class QueryResult:
    """What an engine returns: a lazy DataFrame and its text, or a code that says why not."""

    success: bool
    data: Any = None
    engine: str = ""
    error_code: str | None = None
    error_message: str | None = None
    confidence: float = 0.0
    metadata: dict = field(default_factory=dict)

    @classmethod
    def ok(cls, data: Any, engine: str, confidence: float = 1.0, **metadata: Any) -> QueryResult:
        return cls(True, data, engine, confidence=confidence, metadata=metadata)

    @classmethod
    def fail(cls, code: str, engine: str = "", message: str | None = None, **metadata: Any) -> QueryResult:
        return cls(False, None, engine, code, message or QUERY_MESSAGES.get(code, code), 0.0, metadata)
