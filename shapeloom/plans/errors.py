"""Error rows: codes for programs, messages that are fit for clients."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VALIDATION_ERROR = "VALIDATION_ERROR"
UPSTREAM_TIMEOUT = "UPSTREAM_TIMEOUT"
UPSTREAM_UNAVAILABLE = "UPSTREAM_UNAVAILABLE"
UPSTREAM_ERROR = "UPSTREAM_ERROR"
INTERNAL_ERROR = "INTERNAL_ERROR"
BAD_GATEWAY = "BAD_GATEWAY"
INVALID_REQUEST = "INVALID_REQUEST"

GENERIC = "An error occurred processing your request"


@dataclass(frozen=True)
class Failure:
    """What went wrong, by the words that a message may have."""

    words: str
    message: str  #: for clients
    code: str = INTERNAL_ERROR


_LATE = Failure("(?i)deadline exceeded|timed out|i/o timeout", "Request timeout", UPSTREAM_TIMEOUT)
_GIVEN_UP = Failure("(?i)context canceled|cancelled", "Request cancelled")
_NETWORK = "connection refused|connection reset|no such host|server misbehaving"
_CUT_OFF = Failure(f"{_NETWORK}|broken pipe", "Service temporarily unavailable", UPSTREAM_UNAVAILABLE)
_OUT_OF_REACH = Failure(f"(?i){_NETWORK}|network is unreachable", "Service temporarily unavailable", UPSTREAM_UNAVAILABLE)
#: What clients must not see, and what they see instead.
_HIDDEN = {r"\w+_service/\w+:": "", r"https?://\S+": "[url]"}


def _first(x: Column, failures: Sequence[Failure], told: Callable[[Failure], str], otherwise: Column) -> Column:
    """What is told of the first failure whose words are in the message."""
    return reduce(lambda rest, f: F.when(x.rlike(f.words), told(f)).otherwise(rest), reversed(failures), otherwise)


def safe_message(x: Column | str) -> Column:
    """A message without providers and addresses; timeouts and lost connections in plain words, nothing as a
    generic message."""
    x = F.col(x) if isinstance(x, str) else x
    bare = F.trim(reduce(lambda s, h: F.regexp_replace(s, h[0], h[1]), _HIDDEN.items(), x))
    said = F.when(bare.isin("", ":"), GENERIC).otherwise(bare)
    return F.coalesce(_first(x, [_LATE, _GIVEN_UP, _CUT_OFF], lambda f: f.message, said), F.lit(GENERIC))


def code_of(x: Column | str) -> Column:
    """The code of an error by its message."""
    return _first(F.col(x) if isinstance(x, str) else x, [_LATE, _OUT_OF_REACH], lambda f: f.code, F.lit(INTERNAL_ERROR))


def code_of_status(status: int) -> str:
    """The code of an error that names none."""
    return {400: INVALID_REQUEST}.get(status, INTERNAL_ERROR)
