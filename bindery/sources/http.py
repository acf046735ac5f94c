"""HTTP calls over urllib: user agents in turn, retries of busy servers, timing, and a request-log row per call.

A ``Client`` is plain data, so that it travels to executors; it opens a connection for each call.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers that are worth another try.
RETRIED = (429, 500, 502, 503, 504)
#: What a call adds to its row.
ANSWER = "body string, status_code string, duration_s double, user_agent string, ts_utc string, attempts int, notes string"


@dataclass(frozen=True)
class Answer:
    """The last try of a call: a body only for a status below 400."""

    body: str | None
    status: int | None
    duration: float
    agent: str
    at: str
    attempts: int
    notes: str | None


@dataclass(frozen=True)
class Client:
    """GET requests.  Tries are ``backoff`` seconds apart, then twice that, and so on."""

    agents: tuple[str, ...] = ("bindery/1.0",)
    attempts: int = 4
    backoff: float = 0.5
    timeout: float = 15.0
    sleep: Callable[[float], None] = time.sleep

    def get(self, url: str, turn: int = 0) -> Answer:
        agent, notes = self.agents[turn % len(self.agents)], None
        began, at = time.monotonic(), datetime.now(timezone.utc).isoformat(timespec="seconds")
        for k in range(1, self.attempts + 1):
            status, body = None, None
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=self.timeout) as reply:
                    status = reply.status
                    body = reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")
                    notes = None
            except urllib.error.HTTPError as e:
                status, notes = e.code, f"HTTP {e.code}"
            except OSError as e:
                notes = type(e).__name__
            if body is not None or (status is not None and status not in RETRIED):
                break
            if k < self.attempts:
                self.sleep(self.backoff * 2 ** (k - 1))
        return Answer(body, status, time.monotonic() - began, agent, at, k, notes)

    def fetch(self, url: str) -> str:
        """The body; raises ``OSError`` where the last try failed."""
        answer = self.get(url)
        if answer.body is None:
            raise OSError(answer.notes or "no answer")
        return answer.body


def volumes_url(base: str, query: str, max_results: int = 5, key: str | None = None, country: str | None = None) -> str:
    """The address of a volume search for at most ``max_results`` candidates; ``+`` in a query stays as it is."""
    asked = {"maxResults": str(max_results)} | ({"country": country} if country else {}) | ({"key": key} if key else {})
    return f"{base}?{urllib.parse.urlencode(asked)}&q={urllib.parse.quote(query, safe='+:')}"


def search_url(base: str, query: str, page: int) -> str:
    return f"{base}?{urllib.parse.urlencode({'q': query, 'page': page})}"


def called(requests: DataFrame, client: Client, url: str = "url", pause: float = 0.0) -> DataFrame:
    """``requests`` with the answer to each address (``ANSWER``); nulls without an address.

    Calls run on the executors; each partition makes one at a time, ``pause`` seconds apart.  The rows are what
    ``sinks.append_requests`` logs, so a caller writes them once before using the bodies.
    """
    names = [c.split()[0] for c in ANSWER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.string()]
    schema = requests.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ANSWER.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            rows = []
            for address in batch.column(url).to_pylist():
                if not address:
                    rows.append((None,) * len(names))
                    continue
                if pause and turn:
                    time.sleep(pause)
                a = client.get(address, turn)
                turn += 1
                rows.append((a.body, None if a.status is None else str(a.status), a.duration, a.agent, a.at, a.attempts, a.notes))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return requests.mapInArrow(run, schema)


def search_pages(fetch: Callable[[int], str], count: Callable[[str], int], max_records: int = 15, max_pages: int = 3, pause: float = 0.8, errors: int = 2, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str]]:
    """Pages in turn until they hold ``max_records`` records, ``max_pages`` were read, or ``errors`` calls failed.

    A failed page is asked for again after a pause.  One caller walks the pages, as each decides about the next.
    """
    page, held, failed = 1, 0, 0
    while held < max_records and page <= max_pages:
        try:
            html = fetch(page)
        except OSError:
            failed += 1
            if failed >= errors:
                return
            sleep(pause)
            continue
        yield page, html
        held += count(html)
        page += 1
        if held < max_records and page <= max_pages:
            sleep(pause)
