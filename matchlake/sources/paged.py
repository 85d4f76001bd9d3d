"""Paged remote sources as a Spark data source (S6 to S8): a partition a scope and range of pages."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Iterable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: When each host may be asked again, for all threads of a worker process.
_free_at: dict[str, float] = {}
_lock = threading.Lock()


def _shared(folder: str, host: str):
    """The file system and path of the note that says when a host may be asked again."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return system, f"{root}/{host.replace(':', '_')}.until"


def _shared_wait(folder: str, host: str) -> float:
    """Seconds until a host may be asked, by the note that some task of the cluster left; a note that is being replaced says nothing."""
    system, at = _shared(folder, host)
    try:
        with system.open_input_stream(at) as f:
            return float(f.read() or 0) - time.time()
    except (OSError, ValueError):
        return 0.0


def _share(folder: str, host: str, until: float) -> None:
    system, at = _shared(folder, host)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(b"%.3f" % until)


def fetch_json(url: str, headers: dict[str, str], tries: int = 9, wait_s: float = 1.0, shared: str | None = None) -> object:
    """GET with back-off where the server asks for it (R4); other errors are raised, and the last refusal.

    A refusal holds up every request of this process to the same host, for as long as the server says or twice as
    long each time, and up to a tenth more, so that waiting requests don't return at once. With a shared folder it holds up
    those of all processes of the cluster: the time is noted in a file of the host there, by the wall clock.
    """
    host = urlsplit(url).netloc
    for turn in range(tries):
        with _lock:
            wait = _free_at.get(host, 0.0) - time.monotonic()
        if shared:
            wait = max(wait, _shared_wait(shared, host))
        if wait > 0:
            time.sleep(wait)
        try:
            with urlopen(Request(url, headers=headers), timeout=30) as reply:  # noqa: S310
                return json.loads(reply.read())
        except HTTPError as e:
            if e.code != 429 or turn == tries - 1:
                raise
            pause = float(e.headers.get("Retry-After") or wait_s * 2**turn) * random.uniform(1.0, 1.1)  # noqa: S311
            with _lock:
                _free_at[host] = max(_free_at.get(host, 0.0), time.monotonic() + pause)
            if shared and _shared_wait(shared, host) < pause:
                _share(shared, host, time.time() + pause)
    raise AssertionError


class PagedJson(DataSource):
    """Options: url with {scope} and {page}; scopes, comma-separated; rows, a key of the reply that holds the list
    (default: the reply is the list); total, a key that holds the number of all rows of a scope; first (1);
    pages and per_task; wait_s; header.<name>; backoff, a folder that all executors share, for refusals. Rows are
    (scope, page, value JSON).

    A scope is read until a page is empty, or until as many rows have come as total says, whichever is first. With
    pages (the number of pages at most) a partition is a range of per_task pages (16); without, it is a whole scope.

    With pushdown=true, for which Spark wants spark.sql.python.filterPushdown.enabled, filters on scope (equal, IN) and bounds
    of page are pushed down: only their partitions are planned, and only their pages are asked for. Pages of a scope are taken to
    have no gap: one behind an empty page is read if a bound asks for it, where a whole read would have stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "scope string, page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return (_Pruning if str(self.options.get("pushdown")).lower() == "true" else _Reader)(dict(self.options))


class _Range(InputPartition):
    def __init__(self, scope: str, start: int, stop: int | None):
        super().__init__((scope, start, stop))
        self.scope, self.start, self.stop = scope, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first = int(options.get("first", 1))

        self.scopes = self.options.get("scopes", "").split(",")
        self.stop = self.first + int(self.options["pages"]) if "pages" in self.options else None
        self.start = self.first

    def partitions(self) -> list[InputPartition]:
        if "pages" not in self.options:
            return [_Range(s, self.start, self.stop) for s in self.scopes if self.stop is None or self.start < self.stop]
        step = int(self.options.get("per_task", 16))
        return [_Range(s, k, min(k + step, self.stop)) for s in self.scopes for k in range(self.start, self.stop, step)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark makes one of no partitions
            return
        o, page, seen, before = self.options, partition.start, 0, None
        headers = {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        while partition.stop is None or page < partition.stop:
            got = fetch_json(o["url"].format(scope=partition.scope, page=page), headers, wait_s=float(o.get("wait_s", 1.0)), shared=o.get("backoff"))
            rows = got.get(o["rows"]) if "rows" in o and isinstance(got, dict) else got
            if not rows:
                return
            for row in rows:
                yield partition.scope, page, json.dumps(row, sort_keys=True)
            seen += len(rows)
            if before is None:  # pages before this range are as long as its first, or longer if that is the last
                before = (partition.start - self.first) * len(rows)
            if "total" in o and before + seen >= int(got[o["total"]]):
                return
            page += 1


class _Pruning(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what scopes and page bounds can say; give the rest back."""
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column == "scope" and isinstance(f, (EqualTo, EqualNullSafe)):
                self.scopes = [s for s in self.scopes if s == value]
            elif column == "scope" and isinstance(f, In):
                self.scopes = [s for s in self.scopes if s in f.value]
            elif column == "page" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and value is not None:
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.start = max(self.start, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.stop = end if self.stop is None else min(self.stop, end)
            else:
                yield f
