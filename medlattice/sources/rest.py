"""Paged REST search as a Python data source: one input partition for each resource type.

    spark.dataSource.register(RestSearch)
    spark.read.format("rest_search").option("base_url", ...).option("types", "Patient,Encounter").load()

As a stream it pulls what has changed since. An offset is an instant; a micro-batch holds the resources whose meta.lastUpdated is from the
one offset (included) to the next (excluded), asked of the server and checked again here. Offsets are in the query's checkpoint, so that a
pull that was stopped goes on where it was: nothing is lost, nothing comes twice. `settle` seconds keep the newest offset behind the clock,
for servers that show a change later than they date it; `splits` cuts a long catch-up into that many partitions for each type.

The transport is a class named by its import path, so that tests run without a network.
"""

from __future__ import annotations

import importlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed values of the retry policy.
ATTEMPTS, BASE_S, CAP_S, RETRIED = 5, 0.5, 30.0, (429, 500, 502, 503, 504)
ROW = "payload string, source_ref string, line_number bigint, parse_error string, raw_text string, mode string"


class RestError(RuntimeError):
    pass


@dataclass(frozen=True)
class Reply:
    status: int
    body: str
    retry_after: str | None = None


class UrlTransport:
    """Plain HTTP GET."""

    def get(self, url: str) -> Reply:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/fhir+json"}), timeout=60) as r:
                return Reply(r.status, r.read().decode())
        except urllib.error.HTTPError as e:
            return Reply(e.code, e.read().decode(errors="replace"), e.headers.get("Retry-After"))


class FileTransport:
    """Recorded pages in a folder of any file system: file:///folder/Patient is Patient.json there; query texts are left out."""

    def get(self, url: str) -> Reply:
        fs, path = pafs.FileSystem.from_uri(url.partition("?")[0])
        try:
            with fs.open_input_stream(path if path.endswith(".json") else f"{path}.json") as f:
                return Reply(200, f.read().decode())
        except FileNotFoundError:
            return Reply(404, "")


def delay(attempt: int, retry_after: str | None, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: a numeric Retry-After wins, else full jitter below a doubling cap."""
    if retry_after and retry_after.strip().isdigit():
        return float(retry_after)
    return draw() * min(CAP_S, BASE_S * 2 ** (attempt - 1))


def fetch(transport, url: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page as JSON. Transport errors and RETRIED statuses are tried again, other errors and non-JSON pages are not."""
    why = ""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            reply = transport.get(url)
        except OSError as e:
            reply, why = None, str(e)
        if reply is not None and reply.status == 200:
            try:
                return json.loads(reply.body)
            except ValueError as e:
                raise RestError(f"{url}: not JSON") from e
        if reply is not None:
            why = f"status {reply.status}"
            if reply.status not in RETRIED:
                raise RestError(f"{url}: {why}")
        if attempt < ATTEMPTS:
            sleep(delay(attempt, reply.retry_after if reply else None))
    raise RestError(f"{url}: {why} after {ATTEMPTS} attempts")


def entries(page: dict) -> list[tuple[dict, str]]:
    """(resource, mode) of a page, checked as a whole first. Outcomes of severity error or fatal raise; warnings are left out."""
    if page.get("resourceType") != "Bundle":
        raise RestError(f"expected a Bundle, got {page.get('resourceType')!r}")
    found = page.get("entry", [])
    if not isinstance(found, list) or not all(isinstance(e, dict) and isinstance(e.get("resource"), dict) for e in found):
        raise RestError("entries must be objects with a resource")
    out = []
    for e in found:
        r = e["resource"]
        if r.get("resourceType") == "OperationOutcome":
            if any(i.get("severity") in ("error", "fatal") for i in r.get("issue", [])):
                raise RestError(json.dumps(r.get("issue"))[:300])
            continue
        out.append((r, (e.get("search") or {}).get("mode", "match")))
    return out


def next_link(page: dict) -> str | None:
    return next((x.get("url") for x in page.get("link", []) if x.get("relation") == "next"), None)


def search(transport, base_url: str, kind: str, params: dict[str, str] | list[tuple[str, str]], max_pages: int | None = None, max_resources: int | None = None, sleep=time.sleep) -> Iterator[tuple[dict, str, str]]:
    """(resource, mode, url) over all pages. Parameters go with the first request only; a url that comes again is an error; limits of
    0 ask nothing."""
    if max_pages is not None and max_pages < 0 or max_resources is not None and max_resources < 0:
        raise ValueError("limits can't be negative")
    url: str | None = f"{base_url.rstrip('/')}/{kind}" + (f"?{urllib.parse.urlencode(params)}" if params else "")
    seen: set[str] = set()
    pages = given = 0
    while url and (max_pages is None or pages < max_pages) and (max_resources is None or given < max_resources):
        if url in seen:
            raise RestError(f"page {url} comes again")
        seen.add(url)
        page = fetch(transport, url, sleep)
        pages += 1
        for r, mode in entries(page):
            if max_resources is not None and given >= max_resources:
                return
            given += 1
            yield r, mode, url
        url = next_link(page)


def _transport(options: dict[str, str]):
    module, _, name = options.get("transport", f"{__name__}.UrlTransport").rpartition(".")
    return getattr(importlib.import_module(module), name)()


@dataclass
class TypePartition(InputPartition):
    kind: str


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [TypePartition(t.strip()) for t in self.options["types"].split(",") if t.strip()]

    def read(self, partition: TypePartition) -> Iterator[tuple]:
        transport = _transport(self.options)
        params = {k: self.options[o] for o, k in (("count", "_count"), ("since", "_lastUpdated"), ("include", "_include")) if o in self.options}
        if "_lastUpdated" in params:
            params["_lastUpdated"] = f"ge{params['_lastUpdated']}"
        limit = lambda o: int(self.options[o]) if o in self.options else None
        for i, (r, mode, url) in enumerate(search(transport, self.options["base_url"], partition.kind, params, limit("max_pages"), limit("max_resources")), 1):
            yield json.dumps(r), url, i, None, None, mode


@dataclass
class Window(InputPartition):
    kind: str
    since: str
    until: str


def instant(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def stamp(t: datetime) -> str:
    return t.astimezone(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


class PullReader(DataSourceStreamReader):
    """Resources by the time of their last change. Those without one come with the first batch of a pull that has no `since`."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": stamp(instant(self.options["since"])) if "since" in self.options else ""}

    def latestOffset(self) -> dict:
        end = instant(self.options["until"]) if "until" in self.options else datetime.now(UTC) - timedelta(seconds=float(self.options.get("settle", "60")))
        return {"until": stamp(end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = start["until"], end["until"]
        if since and instant(since) >= instant(until):  # a clock that went back asks for nothing
            return []
        edges = [since, until]
        if since and (n := int(self.options.get("splits", "1"))) > 1:
            a, b = instant(since), instant(until)
            edges = [since, *(stamp(a + (b - a) * k / n) for k in range(1, n)), until]
        return [Window(t.strip(), x, y) for t in self.options["types"].split(",") if t.strip() for x, y in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Window) -> Iterator[tuple]:
        transport = _transport(self.options)
        params = [("_count", self.options["count"])] if "count" in self.options else []
        params += [("_lastUpdated", f"ge{partition.since}")] if partition.since else []
        params += [("_lastUpdated", f"lt{partition.until}")]
        since, until = (instant(x) if x else None for x in (partition.since, partition.until))
        for i, (r, mode, url) in enumerate(search(transport, self.options["base_url"], partition.kind, params), 1):
            at = (r.get("meta") or {}).get("lastUpdated")
            if (since is None) if at is None else (since is None or since <= instant(at)) and instant(at) < until:
                yield json.dumps(r), url, i, None, None, mode

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class RestSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_search"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))

    def streamReader(self, schema) -> PullReader:
        return PullReader(dict(self.options))
