"""Options of one audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from hrefwarden.functions import fixed


class DeadLinks(Exception):
    """Raised on request when an audit has found dead links."""


def _url_set(urls: str | Iterable[str]) -> frozenset[str]:
    listed = urls.split(",") if isinstance(urls, str) else urls
    return frozenset(url.strip() for url in listed if url.strip())


@dataclass
class AuditOptions:
    file_types: str = "supported"
    #: comma-separated text or a collection; compared with the normalised URL
    ignore_urls: str | Iterable[str] = field(default_factory=frozenset)
    #: hours for which a URL seen valid is not asked again
    ttl_hours: int = 24
    #: time of the run, UTC; if not given, the time at which a run starts
    as_of: dt.datetime | None = None
    #: where the audited folder is published; replaces it in reports
    base_folder: str | None = None
    base_url: str | None = None
    show_redirects: bool = True
    show_exceptions: bool = True
    raise_for_dead_links: bool = False
    #: fetch(url) -> (status, failure), called inside tasks
    fetch: Callable[[str], tuple[int | None, str | None]] | None = None
    fetch_doi: Callable[[str], tuple[int | None, str | None]] | None = None
    #: tasks that probe, tasks that may share one host, threads in each task
    probe_partitions: int | None = None
    lanes_per_host: int = 32
    threads_per_task: int = 1
    #: parts the targets are asked in; a run that is started again asks one of them twice at most
    probe_slices: int = 4
    #: directory of the two cache tables; None keeps no cache
    cache_path: str | None = None
    #: directory of what was read of a tree; files unchanged since are not read again. None reads all
    snapshot_path: str | None = None

    def __post_init__(self):
        if self.file_types not in fixed.FILE_TYPES:
            raise ValueError(f"file_types must be one of {sorted(fixed.FILE_TYPES)}")
        self.ignore_urls = _url_set(self.ignore_urls)
        if self.as_of is not None and self.as_of.tzinfo is None:
            self.as_of = self.as_of.replace(tzinfo=dt.timezone.utc)
        if self.base_url:
            self.base_url = self.base_url.rstrip("/")

    def for_run(self, **changes) -> "AuditOptions":
        """A copy for one run, with the time of the run filled in."""
        now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
        return replace(self, **({"as_of": self.as_of or now} | changes))

    @property
    def suffixes(self) -> tuple[str, ...]:
        return fixed.FILE_TYPES[self.file_types]
