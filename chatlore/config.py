"""Job parameters and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match)
# ---------------------------------------------------------------------------
# Characters Python's str.strip() removes (str.isspace), as hex code points:
# 9-d, 1c-1f, 20, 85, a0, 1680, 2000-200a, 2028, 2029, 202f, 205f, 3000.
PY_SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Direct-message texts answered with the greeting instead of a retrieval.
SMALL_TALK = ("hi", "hello", "hey", "help", "morning", "ping")
# Reply sent when retrieval or generation fails.
ERROR_REPLY = "I encountered an error while consulting the archives."
# Author shown when the user id is null or empty.
UNKNOWN_AUTHOR = "Unknown"
# Context block: cited documents are joined by a rule line.
CONTEXT_SEPARATOR = "\n\n---\n\n"
MISSING_URL = "No URL available"
MISSING_AUTHOR = "Unknown Author"
# The workspace domain of permalinks defaults to "app".
DEFAULT_DOMAIN = "app"
DEFAULT_TOP_K = 5
# ---------------------------------------------------------------------------

# Our own defaults (not reference text): persona text and greeting are job
# parameters; a deployment passes its own.
DEFAULT_SYSTEM_PROMPT = (
    "You are a team knowledge assistant. Answer from the provided context and "
    "cite the author and the message link. If the answer is not in the "
    "context, say that you do not have that knowledge."
)
DEFAULT_GREETING = (
    "Hello! I search the team's channel history for you. Ask me a question and "
    "I will answer with a link to the original discussion."
)
NO_CONTEXT_ANSWER = "I do not have that knowledge."


@dataclass(frozen=True)
class Params:
    """Everything the reference read from its YAML config, as one value."""

    targets: tuple[str, ...] | None = None  # None = every channel
    history_cap: int | None = None  # newest messages per channel and run; None = all
    reply_cap: int | None = None  # thread elements per fetch (parent included); None = all
    domain: str = DEFAULT_DOMAIN
    top_k: int = DEFAULT_TOP_K
    metric: str = "l2sq"
    scope_by_channel: bool = False  # memory per channel; off: equal thread_ts of two channels share it
    search: str = "exact"  # "exact" top-k, or "ivf" (inverted lists, same rows) for clustered corpora
    ivf_lists: int | None = None  # None: about sqrt(corpus rows)
    dim: int = 64
    temperature: float = 0.1
    model: str = "extractive"
    system_prompt: str = DEFAULT_SYSTEM_PROMPT
    greeting: str = DEFAULT_GREETING
    small_talk: tuple[str, ...] = field(default=SMALL_TALK)
