"""Default operator arguments.

The numbers and lists here are fixed values: they are the defaults users of this kind of
retrieval service configure against, so results only agree when they are equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DEFAULT_BRANCH = "main"
DEFAULT_CONTENT_PATH = "content/docs"
DEFAULT_EMBEDDING_TOKEN_LIMIT = 8192
MOVING_PREFIX = "__moving__"

# Embedding input limits by model name, in declaration order.
EMBEDDING_MODEL_TOKEN_LIMITS = (
    ("text-embedding-3-large", 8192),
    ("text-embedding-3-small", 8192),
    ("text-embedding-ada-002", 8192),
    ("text-embedding-ada-002-v2", 8192),
)

# Default exclude patterns of a code scan.
DEFAULT_EXCLUDE_PATTERNS = (
    "*.test.ts",
    "*.test.tsx",
    "*.spec.ts",
    "*.spec.tsx",
    "*.test.js",
    "*.test.jsx",
    "*.spec.js",
    "*.spec.jsx",
    "test/",
    "__tests__/",
    "tests/",
    "test_*.py",
    "*_test.py",
    "*_tests.py",
    "*_test.rs",
    "*_tests.rs",
    "benches/",
)


@dataclass(frozen=True)
class SearchDefaults:
    match_count: int = 10
    keyword_match_count: int | None = 10
    similarity_threshold: float = 0.2
    hybrid: bool = True


@dataclass(frozen=True)
class CallLimits:
    """Limits of one model endpoint.

    They are held while calling: rows go through ``concurrency`` lanes, and each lane waits for its share
    of requests and tokens a minute. Only without ``paced``, or for a model that says that it runs
    inside the task (an attribute ``in_task``), do calls run as wide as the data.
    """

    batch_size: int = 100
    concurrency: int = 8
    requests_per_minute: int = 1500
    tokens_per_minute: int = 6_250_000
    retries: int = 1
    paced: bool = True


@dataclass(frozen=True)
class Settings:
    search: SearchDefaults = field(default_factory=SearchDefaults)
    embedding: CallLimits = field(default_factory=CallLimits)
    chat: CallLimits = field(
        default_factory=lambda: CallLimits(
            batch_size=1, requests_per_minute=500, tokens_per_minute=90_000, retries=5
        )
    )
    chat_max_output_tokens: int = 8000
