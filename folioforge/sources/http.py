"""Fetching over HTTP with a retry policy: what the paged connectors and the page hints read through where there is a network."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from .datasource import waits


@dataclass(frozen=True)
class Policy:
    """Attempts, pauses between them (doubling from ``base_s`` up to ``max_s``, and up to ``jitter_s`` more) and the statuses worth one more."""

    attempts: int = 3
    base_s: float = 0.25
    max_s: float = 2.0
    jitter_s: float = 0.1
    statuses: frozenset[int] = frozenset({429, 500, 502, 503, 504})


ONCE = Policy(1, 0.0, 0.0, 0.0, frozenset())


def fetch(url: str, timeout_s: float, min_interval_s: float = 0.0, policy: Policy = ONCE, open_url: Callable = urlopen, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, str]:
    """Body and character set (empty if not named) of an address.

    Statuses of the policy, lost connections and time-outs are tried again; any other status is an error
    at once.  Every call ends with the least interval between calls.
    """
    pauses = waits(policy.attempts, policy.base_s, policy.max_s)
    for k in range(max(1, policy.attempts)):
        try:
            with open_url(url, timeout=timeout_s) as answer:
                body, headers = answer.read(), getattr(answer, "headers", None)
            if min_interval_s > 0:
                sleep(min_interval_s)
            return body, (headers.get_content_charset() or "") if headers is not None else ""
        except HTTPError as e:
            if e.code not in policy.statuses or k >= len(pauses):
                raise
        except (URLError, TimeoutError):
            if k >= len(pauses):
                raise
        sleep(min_interval_s + pauses[k] + random.uniform(0.0, policy.jitter_s))
    raise AssertionError("unreachable")


def get_json(url: str, params: dict, **how) -> dict:
    """The JSON answer; parameters that are empty or null aren't sent."""
    sent = urlencode({k: v for k, v in params.items() if v not in (None, "")})
    return json.loads(fetch(f"{url}?{sent}" if sent else url, **how)[0].decode("utf-8"))


def get_text(url: str, **how) -> str:
    """The text of a page in the character set it names, or in UTF-8 if that is none."""
    body, charset = fetch(url, **how)
    try:
        return body.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return body.decode("utf-8", errors="replace")
