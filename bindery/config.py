"""Settings of the batch jobs from the environment and the command line."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Settings of a lookup run; ``from_env`` reads them from variables."""

    api_key: str
    rate_limit: float = 0.6
    country: str | None = None
    max_results: int = 5
    use_isbn: bool = False
    #: Fields asked for where a record has none of its own: publisher, subject, lccn, oclc.
    fallbacks: dict[str, str] = field(default_factory=dict)

    def fallback_query(self) -> str | None:
        """What a record without ISBN, title and author asks for; null without fallbacks."""
        named = {"publisher": "inpublisher:", "subject": "subject:", "lccn": "lccn:", "oclc": "oclc:"}
        return "+".join(named[k] + v.replace(" ", "+") for k, v in self.fallbacks.items()) or None

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Settings:
        """Fails without the mandatory key; blank values count as absent."""
        given = {k: v.strip() for k, v in (os.environ if env is None else env).items() if v.strip()}
        if "GOOGLE_BOOKS_API_KEY" not in given:
            raise ValueError("GOOGLE_BOOKS_API_KEY must be set")
        fallbacks = {name: given[f"GB_{name.upper()}"] for name in ("publisher", "subject", "lccn", "oclc") if f"GB_{name.upper()}" in given}
        return Settings(given["GOOGLE_BOOKS_API_KEY"], float(given.get("GOOGLE_BOOKS_RATE_LIMIT", "0.6")), given.get("GOOGLE_BOOKS_COUNTRY"), int(given.get("GOOGLE_BOOKS_MAX_RESULTS", "5")), given.get("GOODREADS_USE_ISBN", "").lower() in ("1", "true", "yes"), fallbacks)
