"""Fetching as a scan: ``spark.read.format("leadloom-http")`` gives landed responses, one partition for each source.

Sources are fetched side by side, the pages of one source after another with a
pause, so the number of tasks at once is the number of requests at once. What
comes back has the schema that the readers take; write it down before reading
it twice, or it is fetched twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from leadloom.sources.schema import RESPONSE

#: Statuses that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Plan:
    """One source. url may hold {page} and {offset}; pages: how many at most; size: items that an offset counts for
    a page. A page that is missing, empty or an empty list is the last one."""

    source_id: str
    adapter: str
    url: str
    organization: str | None = None
    config: dict = field(default_factory=dict)
    pages: int = 1
    size: int = 100
    pause: float = 1.5
    tries: int = 3
    most_bytes: int = 8_000_000
    timeout: float = 20.0


class _Partition(InputPartition):
    def __init__(self, plan: Plan):
        self.plan = plan


class _Guard(HTTPRedirectHandler):
    """Redirects stay on http and https, and on the hosts that are allowed."""

    def __init__(self, hosts: tuple[str, ...]):
        self.hosts = hosts

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        permitted(newurl, self.hosts)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def permitted(url: str, hosts: tuple[str, ...]) -> None:
    """Raise unless a url may be fetched: http or https, no credentials, and a host of the list, if there is one."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or "@" in parts.netloc:
        raise URLError("only plain http and https urls are fetched")
    if hosts and parts.hostname.lower() not in hosts:
        raise URLError(f"{parts.hostname} is not among the hosts that may be fetched")


def fetch(plan: Plan, url: str, hosts: tuple[str, ...]) -> tuple[int, str]:
    """(status, body) of one url; 599 if there is no answer, 413 if it is too large. Other errors than AGAIN aren't tried again."""
    opener = build_opener(_Guard(hosts))
    status = 599
    for attempt in range(plan.tries):
        if attempt:
            time.sleep(plan.pause * 2**attempt)
        try:
            permitted(url, hosts)
            with opener.open(Request(url, headers={"User-Agent": "leadloom"}), timeout=plan.timeout) as answer:
                body = answer.read(plan.most_bytes + 1)
                return (413, "") if len(body) > plan.most_bytes else (answer.status, body.decode("utf-8", "replace"))
        except HTTPError as e:
            status = e.code
            if status not in AGAIN:
                return status, ""
        except (URLError, OSError, ValueError):
            status = 599
    return status, ""


class _Reader(DataSourceReader):
    def __init__(self, plans: list[Plan], hosts: tuple[str, ...]):
        self.plans, self.hosts = plans, hosts

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on source_id and adapter leave sources unfetched; Spark applies all others."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, EqualTo | In) and name in (("source_id",), ("adapter",)):
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.plans = [p for p in self.plans if getattr(p, name[0]) in allowed]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Partition(p) for p in self.plans]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = partition.plan
        for page in range(p.pages):
            if page:
                time.sleep(p.pause)
            url = p.url.replace("{page}", str(page)).replace("{offset}", str(page * p.size))
            status, body = fetch(p, url, self.hosts)
            over = status in (204, 404, 410) or body.strip() in ("", "[]")
            if page and over:
                return
            yield p.source_id, p.adapter, p.organization, json.dumps(p.config), page, url, status, body
            if over or status >= 400:
                return


class HttpSource(DataSource):
    """Options: sources, a JSON array of the fields of Plan; hosts, a JSON array of hosts that may be fetched (all, if left out)."""

    @classmethod
    def name(cls) -> str:
        return "leadloom-http"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> DataSourceReader:
        plans = [Plan(**p) for p in json.loads(self.options["sources"])]
        return _Reader(plans, tuple(h.lower() for h in json.loads(self.options.get("hosts", "[]"))))


def register(spark) -> None:
    spark.dataSource.register(HttpSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
