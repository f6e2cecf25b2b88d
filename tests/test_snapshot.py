"""A second run reads what has changed and reports the same as one that reads all."""

import os

import pytest

from hrefwarden import AuditOptions
from hrefwarden.functions import fixed
from hrefwarden.plans import audit
from hrefwarden.sources import files, snapshot


@pytest.fixture
def site(tmp_path):
    folder = tmp_path / "site"
    (folder / "sub").mkdir(parents=True)
    for k in range(6):
        (folder / f"sub/{k}.md").write_text(f"[t](http://e{k}.org) <http://f{k}.org>")
    (folder / "b.bib").write_text("@misc{k, url = {http://b.org}, doi = {10.1/x}}")
    return folder


def report(spark, site, **options):
    def fetch(url):
        return 404, None

    done = audit.check(spark, str(site), AuditOptions(fetch=fetch, **options), write_to=str(site.parent / "report"))
    links = sorted((os.path.basename(r.path), r.pos, r.url, r.linktext) for r in done.links.collect())
    listed = sorted((r.path, r.n, r.pos, r.url) for r in done.listing("error").collect())
    problems = sorted((r.path, r.problem) for r in done.access_errors.collect())
    return links, listed, problems, sorted(r.doi for r in done.dois.collect())


def test_unchanged_files_are_not_read(spark, site, monkeypatch, tmp_path):
    kept = dict(snapshot_path=str(tmp_path / "snap"))
    read = []
    whole = files.read_files
    monkeypatch.setattr(files, "read_files", lambda listing: read.append(sorted(os.path.basename(r.path) for r in listing.collect())) or whole(listing))
    assert report(spark, site, **kept) == report(spark, site)
    assert len(read[0]) == 7
    assert report(spark, site, **kept) == report(spark, site) and read[2] == []

    (site / "sub/1.md").write_text("[new](http://new.org)")
    (site / "sub/2.md").unlink()
    (site / "sub/7.md").write_text("<http://seven.org>")
    (site / "bad.md").write_bytes(b"\xff")
    # Same size and time: taken as it was, which shows that it is not read.
    times = os.stat(site / "sub/3.md")
    (site / "sub/3.md").write_text("[t](http://X3.org) <http://f3.org>")
    os.utime(site / "sub/3.md", ns=(times.st_atime_ns, times.st_mtime_ns))
    found, all_read = report(spark, site, **kept), report(spark, site)
    assert read[4] == ["1.md", "7.md", "bad.md"]
    assert ("3.md", 0, "http://e3.org", "t") in found[0] and ("3.md", 0, "http://X3.org", "t") in all_read[0]
    assert [r for r in found[0] if r[0] != "3.md"] == [r for r in all_read[0] if r[0] != "3.md"]
    assert found[2:] == all_read[2:] and len(found[2]) == 1

    # What had a problem is tried again, and the rest still is not.
    (site / "bad.md").write_text("[ok](http://ok.org)")
    found = report(spark, site, **kept)
    assert read[6] == ["bad.md"] and ("bad.md", 0, "http://ok.org", "ok") in found[0] and found[2] == []
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == ["marker", "snapshot-3", "snapshot-4"]


def test_other_formats_or_extraction_read_all(spark, site, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    report(spark, site, snapshot_path=path)
    assert snapshot.load(spark, path, fixed.SUPPORTED_SUFFIXES).files.count() == 7
    assert snapshot.load(spark, path, (".md",)).files is None
    monkeypatch.setattr(snapshot, "EXTRACTION", 2)
    assert snapshot.load(spark, path, fixed.SUPPORTED_SUFFIXES).files is None
    assert snapshot.load(spark, str(tmp_path / "none"), ()).number == 0
