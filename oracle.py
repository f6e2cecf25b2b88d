"""DuckDB statements for the registered queries, over the same tables.

Every statement starts from the tables; shared steps are common table
expressions that are put in front of those that use them.
"""

from __future__ import annotations

# --- fixed values: link patterns and the reading of host names
BASE_TIME = "TIMESTAMP '2024-01-02 00:00:00'"
HOST_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
MD_INLINE = r"(?i)\[([^\[]*)\]\(([^\)]*?)[\s\)]+"
MD_POINTY = r"<([^>]*?)>"
TEX_HREF = r"(?i)\\href(?:\[.*\])?\{([^}]*)\}\{([^}]*?)\}"
TEX_URL = r"(?i)\\url\{([^{]*?)\}"
HTML_A = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
IGNORED = "http://blog.ththan.example.net/en/960, https://thther.example.org/en/685,https://m.therou.example.com/en/474.html"


def host(u: str) -> str:
    return f"nullif(trim(lower(regexp_extract({u}, '{HOST_RX}', 1)), '[]'), '')"


def norm(u: str, keep_query: bool = False) -> str:
    blanks = r"E' \t\r\n'"
    t = f"trim({u}, {blanks})"
    page = f"rtrim(string_split({t}, '#')[1], {blanks})"
    base = f"rtrim(string_split({page}, '?')[1], {blanks})"
    scheme = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    user = f"regexp_extract({base}, '^[^:]+://([^/]*@)', 1)"
    place = f"lower(regexp_extract({base}, '^[^:]+://(?:[^/]*@)?([^/]*)', 1))"
    port = f"CASE {scheme} WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END"
    path = f"regexp_replace(regexp_extract({base}, '(?s)^[^:]+://[^/]*(.*)', 1), '/{{2,}}', '/', 'g')"
    query = f"regexp_extract({page}, '(?s)^[^?]*[?](.*)', 1)"
    parts = f"[x FOR x IN string_split({query}, '&') IF x <> '']"
    keys = f"[regexp_extract(y, '^([^=]*)', 1) FOR y IN {parts}]"
    ordered = (
        f"CASE WHEN NOT contains({query}, '&') OR len({keys}) > len(list_distinct({keys})) "
        f"THEN {query} ELSE array_to_string(list_sort({parts}), '&') END"
    )
    shown = f"rtrim({query if keep_query else ordered}, {blanks})"
    return (
        f"CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN "
        f"{scheme} || '://' || {user} || regexp_replace({place}, {port}, '') || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN ({shown}) = '' THEN '' ELSE '?' || ({shown}) END ELSE {t} END"
    )


def pairs(source: str, rx: str, url: int, text: int, flags: str = "") -> str:
    """Rows (path, pos, url, linktext) of every match of a pattern."""
    return (
        f"SELECT path, CAST(unnest(range(len(regexp_extract_all(content, '{rx}', 0)))) AS INTEGER) AS pos, "
        f"unnest(regexp_extract_all(content, '{rx}', {url})) AS url, "
        f"unnest(regexp_extract_all(content, '{rx}', {text})) AS linktext FROM {source}"
    )


OUTCOME = """CASE WHEN failure IS NOT NULL THEN 'exception' WHEN status IN (200, 302, 303, 307) THEN 'fine'
 WHEN status IN (301, 308) THEN 'redirect' WHEN status IN (403, 404, 410) THEN 'error' ELSE 'exception' END"""
REASON = """CASE WHEN failure IN ('Timeout', 'ClientConnectorError', 'ClientResponseError', 'ClientOSError', 'Server disconnected') THEN failure
 WHEN failure IS NOT NULL OR status IS NULL THEN 'Unclassified' WHEN status = 429 THEN 'Rate Limit (429)'
 WHEN status NOT IN (200, 302, 303, 307, 301, 308, 403, 404, 410) THEN 'Other (' || status || ')' END"""

CTES = {
    "md": f"""SELECT '/corpus/' || host || '/' || chunk || '.md' AS path, string_agg(line, '' ORDER BY page_id) AS content
 FROM (SELECT page_id, {host('url')} AS host, page_id // 1000 AS chunk,
 '[page ' || page_id || '](' || url || E' "t")\\n' || CASE WHEN page_id % 4 = 0 THEN '<' || url || E'>\\n' ELSE '' END AS line FROM pages)
 GROUP BY host, chunk""",
    "tex": """SELECT '/corpus/' || page_id || '.tex' AS path,
 CASE WHEN page_id % 2 = 0 THEN '\\href[x]{' || url || '}{page ' || page_id || '}' ELSE '\\url{' || url || '}' END AS content FROM pages""",
    "html": "SELECT '/corpus/' || page_id || '.html' AS path, html AS content FROM pages",
    "hostile": r"""SELECT '/corpus/' || doc_id || suffix AS path, suffix, text || chr(10) || repeat(b1, 400) || b2 || replace(link, '@', doc_id::VARCHAR) || repeat(c1, 400) || c2 || repeat(c3, 400) AS content
 FROM documents JOIN (VALUES
 (0, '.md', '[a](', '', ' [t](http://m.example.com/@ ', '[b](', '', ''),
 (1, '.tex', '\href{', '}' || chr(10), '\href[o]{http://t.example.com/@}{t}', '\href[', chr(10), '\href[]{u'),
 (2, '.html', '<a href="x"', '</a>', '<a href="http://h.example.com/@">t</a>', '<a href="y">', '', '')
 ) t(kind, suffix, b1, b2, link, c1, c2, c3) ON doc_id % 3 = kind""",
    "hostile_md": "SELECT path, content FROM hostile WHERE suffix = '.md'",
    "hostile_tex": "SELECT path, content FROM hostile WHERE suffix = '.tex'",
    "hostile_html": "SELECT path, content FROM hostile WHERE suffix = '.html'",
    "md_inline": pairs("md", MD_INLINE, 2, 1),
    "md_pointy": pairs("md", MD_POINTY, 1, 1),
    "md_links": """SELECT path, pos, url, linktext FROM md_inline UNION ALL
 SELECT p.path, CAST(p.pos + coalesce(i.n, 0) AS INTEGER), p.url, p.linktext FROM md_pointy p
 LEFT JOIN (SELECT path, count(*) AS n FROM md_inline GROUP BY path) i ON p.path = i.path""",
    "queue": f"""SELECT path, pos, {host('url')} AS hostname, url, {norm('url')} AS normalized_url, linktext
 FROM md_links WHERE starts_with(url, 'http')""",
    "targets": "SELECT normalized_url, count(*) AS n_links FROM queue GROUP BY normalized_url",
    "by_target": f"SELECT {norm('url')} AS normalized_url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "probe_log": """SELECT normalized_url, CAST(CASE WHEN k <= 3 THEN 200 WHEN k = 4 THEN 301 WHEN k = 5 THEN 404
 WHEN k = 6 THEN 403 WHEN k = 7 THEN 429 WHEN k = 8 THEN 500 END AS INTEGER) AS status,
 CASE WHEN k = 9 THEN 'Timeout' END AS failure FROM (SELECT normalized_url, page_id % 10 AS k FROM by_target)""",
    "fresh": f"""SELECT normalized_url, last_valid FROM (SELECT normalized_url,
 {BASE_TIME} - to_hours(CAST(page_id % 48 AS INTEGER)) AS last_valid FROM by_target) WHERE last_valid > {BASE_TIME} - INTERVAL 24 HOURS""",
    "verdict_all": f"""SELECT t.normalized_url, t.n_links, status, {OUTCOME} AS outcome, {REASON} AS reason
 FROM targets t LEFT JOIN probe_log l ON t.normalized_url = l.normalized_url""",
    "verdict_new": "SELECT * FROM verdict_all v WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.normalized_url = v.normalized_url)",
    "defects": """SELECT path, pos, url, linktext, outcome, coalesce(reason, CAST(status AS VARCHAR)) AS code
 FROM queue q JOIN verdict_all v ON q.normalized_url = v.normalized_url WHERE outcome <> 'fine'""",
    "counts": "SELECT outcome, path, count(*) AS n FROM defects GROUP BY outcome, path",
    "listing": """SELECT d.outcome, d.path, n, pos, url, linktext, code FROM defects d
 JOIN counts c ON d.path = c.path AND d.outcome = c.outcome""",
    "dois": """SELECT '/corpus/' || page_id || '.bib' AS path, CAST(1 AS INTEGER) AS pos, '10.5555/' || page_id AS doi,
 'Key: p' || page_id || ', Field: DOI' AS description FROM pages""",
    "doi_cache": f"SELECT '10.5555/' || page_id AS doi, {BASE_TIME} - INTERVAL 30 DAYS AS last_seen FROM pages WHERE starts_with(url, 'https:')",
    "doi_verdicts": f"""SELECT d.doi, status, CASE WHEN status = 200 THEN 'valid' WHEN status = 404 THEN 'invalid' ELSE 'unexpected' END AS outcome
 FROM (SELECT DISTINCT doi FROM dois WHERE doi NOT IN (SELECT doi FROM doi_cache)) d
 JOIN (SELECT '10.5555/' || page_id AS doi, CAST(CASE WHEN ends_with(url, '.html') THEN 404 WHEN contains(url, 'utm_source') THEN 500 ELSE 200 END AS INTEGER) AS status
 FROM pages) l ON d.doi = l.doi""",
    "raw": """SELECT '/corpus/' || page_id || '.html' AS path, CASE WHEN NOT ends_with(url, '/') THEN length(html) END AS chars,
 CASE WHEN ends_with(url, '/') THEN 'not valid UTF-8' END AS problem FROM pages""",
    "spellings": r"""SELECT page_id, CAST(unnest(range(11)) AS INTEGER) AS spelling, unnest([url,
 ' ' || upper(substring(url, 1, 12)) || substring(url, 13) || ' ',
 regexp_replace(url, '^(https?://[^/]+)', '\1:443'), regexp_replace(url, '^(https?://[^/]+)', '\1:80'),
 regexp_replace(url, '([a-z0-9])/', '\1//', 'g'), regexp_replace(url, '^(https?)://', '\1://Us:Pw@'),
 url || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END) || 'b=2&a=1&&',
 url || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END) || 'a=1&a=1', replace(url, '.', '_'),
 url || ' #x', string_split(url, '?')[1] || ' ?b=2 &a=1 #f']) AS url FROM pages""",
    "prose": "SELECT d.doc_id, d.text, d.source, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id",
    "prose_paths": """SELECT '/corpus/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.tex' WHEN 2 THEN '.html' ELSE '.bib' END AS path,
 doc_id, text, url FROM prose""",
    "prose_findings": """SELECT path, kind, CAST(pos AS INTEGER) AS pos, value, text FROM (
 SELECT path, 'link' AS kind, 0 AS pos, url AS value, 'doc ' || doc_id AS text FROM prose_paths WHERE url IS NOT NULL AND doc_id % 4 < 3
 UNION ALL SELECT path, 'link', 1, url, url FROM prose_paths WHERE url IS NOT NULL AND doc_id % 4 < 2
 UNION ALL SELECT path, 'link', 0, url, 'Key: d' || doc_id || ', Field: Url' FROM prose_paths WHERE url IS NOT NULL AND doc_id % 4 = 3
 UNION ALL SELECT path, 'doi', 1, '10.5555/' || doc_id, 'Key: d' || doc_id || ', Field: DOI' FROM prose_paths WHERE url IS NOT NULL AND doc_id % 4 = 3)""",
    "prose_targets": f"SELECT {norm('value')} AS normalized_url, count(*) AS n_links FROM prose_findings WHERE kind = 'link' GROUP BY 1",
    "prose_verdicts": f"""SELECT t.normalized_url, t.n_links, status, {OUTCOME} AS outcome, {REASON} AS reason
 FROM prose_targets t LEFT JOIN probe_log l ON t.normalized_url = l.normalized_url""",
}


def with_ctes(body: str, *names: str) -> str:
    """Put the named steps, in the order in which they are defined, before ``body``."""
    chosen = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in names)
    return f"WITH {chosen}\n{body}" if chosen else body


MD = ("md", "md_inline", "md_pointy", "md_links")
QUEUE = (*MD, "queue")
JUDGED = (*QUEUE, "targets", "by_target", "probe_log", "verdict_all")
REPORTS = (*JUDGED, "defects", "counts", "listing")
DOIS = ("dois", "doi_cache", "doi_verdicts")


def _report_lines(markdown: bool) -> str:
    shown = "CASE WHEN instr(path, '/corpus') > 0 THEN substring(path, 1, instr(path, '/corpus') - 1) || 'https://www.example.com' || substring(path, instr(path, '/corpus') + 7) ELSE path END"

    def rows(section, rank, path, pos, lines, source):
        listed = ", ".join(lines)
        return (
            f"SELECT {section} AS section, CAST({rank} AS BIGINT) AS rank, {path} AS path, CAST({pos} AS BIGINT) AS pos, "
            f"CAST(unnest(range({len(lines)})) AS INTEGER) AS line, unnest([{listed}]) AS text FROM {source}"
        )

    stats = """(SELECT (SELECT count(*) FROM queue) AS links, count(*) AS checked, count(*) FILTER (outcome = 'fine') AS fine FROM verdict_all)"""
    def heading(title):
        return f"'# {title}'" if markdown else "'" + f" {title} ".center(39, "#") + "'"

    bar = "'" + "#" * 39 + "'"
    title = ["'---'", "'title: Results of Linkcheck'", "'---'"] if markdown else [bar, heading("RESULTS"), bar]
    kind = "links" if markdown else "hyperlinks"
    parts = [
        rows(
            0, "NULL", "''", -3,
            [*title, "''", "'generated: 2024-Jan-02 00:00h'", "''",
             f"'Found ' || links || ' {kind} which had ' || checked || ' distinct targets.'",
             "'Checked those in 2 seconds.'",
             "'This averages to ' || round(checked / 2.0::DOUBLE, 2) || ' checks/second.'", "''",
             "fine || ' of those hyperlinks are fine.'"],
            stats,
        ),
        rows(1, "NULL", "''", -2, ["''", heading("FILE ACCESS ERRORS"), "''"], "(SELECT 1 FROM raw WHERE problem IS NOT NULL LIMIT 1)"),
        rows(1, "0", "path", 0, [f"'* ' || {shown} || ' (' || problem || ')'"], "(SELECT * FROM raw WHERE problem IS NOT NULL)"),
    ]
    meanings = {403: "Forbidden", 404: "Not Found", 410: "Gone"}
    if markdown:
        legend = ["'HTTP status code | Meaning'", "'--:|:--'"] + [f"'{code} | {text}'" for code, text in meanings.items()]
    else:
        legend = [f"'HTTP status code {code} = {text}'" for code, text in meanings.items()]
    for number, outcome, title, empty, column, extra in (
        (2, "error", "PERMANENT ERRORS", "No permanent errors found!", "code", legend),
        (3, "redirect", "PERMANENT REDIRECTS", "No permanent redirects found!", "code", []),
        (4, "exception", "EXCEPTIONS", "No exceptions during the crawl!", "exception", []),
    ):
        here = f"(SELECT count(*) AS n FROM counts WHERE outcome = '{outcome}')"
        if markdown:
            file_lines = ["''", f"'**' || {shown} || '** (' || n || ')'", "''", f"'|{column}| URL and link text |'", "'|--:|:------------------|'"]
            defect_lines = ["'|' || code || ' | [' || url || '](' || url || ')|'", "'| | ' || linktext || ' |'"]
        else:
            file_lines = ["''", f"{shown} || ' ' || n"]
            defect_lines = ["'* ' || code || ': ' || linktext || ' ' || url"]
        parts += [
            rows(number, "NULL", "''", -2, ["''", heading(title), f"'{empty}'"], f"{here} WHERE n = 0"),
            rows(number, "NULL", "''", -2, ["''", heading(title), *extra], f"{here} WHERE n > 0"),
            rows(number, "-n", "path", -1, file_lines, f"(SELECT * FROM counts WHERE outcome = '{outcome}')"),
            rows(number, "-n", "path", "pos", defect_lines, f"(SELECT * FROM listing WHERE outcome = '{outcome}')"),
        ]
    return with_ctes("\nUNION ALL ".join(parts), *REPORTS, "raw")


def statements() -> dict[str, str]:
    found = {
        "supported_format": with_ctes(
            "SELECT path, regexp_extract(path, '[^/](\\.[^./]+)$', 1) AS suffix, regexp_matches(path, '[^/]\\.(htm|html|md|tex|bib)$') AS supported FROM prose_paths",
            "prose", "prose_paths",
        ),
        "doc_format_filter": with_ctes(
            """SELECT CASE k WHEN 0 THEN 'markdown' WHEN 1 THEN 'tex' ELSE 'html' END AS file_type, count(*) AS files, CAST(sum(length(text) + length(added)) AS BIGINT) AS chars
 FROM (SELECT text, doc_id % 4 AS k, CASE doc_id % 4
 WHEN 0 THEN coalesce(E'\\n[doc ' || doc_id || '](' || url || E' "t")\\n<' || url || E'>\\n', '')
 WHEN 1 THEN coalesce(E'\\n\\\\href[x]{' || url || '}{doc ' || doc_id || E'}\\n\\\\url{' || url || E'}\\n', '')
 ELSE '<html><body><p></p></body></html>' || coalesce('<a href="' || replace(url, '&', '&amp;') || '">doc ' || doc_id || '</a>', '') END AS added
 FROM prose_paths WHERE doc_id % 4 < 3) GROUP BY k""",
            "prose", "prose_paths",
        ),
        "decode_problems": with_ctes("SELECT path, chars, problem FROM raw", "raw"),
        "access_errors": with_ctes("SELECT path, problem FROM raw WHERE problem IS NOT NULL", "raw"),
        "cache_fresh_urls": with_ctes("SELECT normalized_url, CAST(epoch(last_valid) AS BIGINT) AS last_valid FROM fresh", "by_target", "fresh"),
        "cache_dois": with_ctes("SELECT doi, CAST(epoch(last_seen) AS BIGINT) AS last_seen FROM doi_cache", "doi_cache"),
        "html_anchors": with_ctes(pairs("html", HTML_A, 1, 2), "html"),
        "html_malformed": with_ctes(
            pairs("html", HTML_A, 1, 2)
            + """ UNION ALL SELECT '/corpus/' || p.page_id || '.html', CAST(len(regexp_extract_all(p.html, '(?is)<a\\s')) + t.nth AS INTEGER), t.url, t.linktext
 FROM pages p JOIN (VALUES (3, 0, 'u', ''), (4, 0, 'v', 'one'), (4, 1, 'w', 'two'), (5, 0, 'y', 'open')) t(kind, nth, url, linktext)
 ON p.page_id % 7 = t.kind""",
            "html",
        ),
        "hostile_markup": with_ctes(
            " UNION ALL ".join(
                f"SELECT path, pos, url, CAST(length(linktext) AS INTEGER) AS text_chars FROM ({pairs(*of)})"
                for of in (("hostile_md", MD_INLINE, 2, 1), ("hostile_tex", TEX_HREF, 1, 2), ("hostile_html", HTML_A, 1, 2))
            ),
            "hostile", "hostile_md", "hostile_tex", "hostile_html",
        ),
        "unsupported_documents": """SELECT '/corpus/' || doc_id || CASE doc_id % 5 WHEN 1 THEN '.txt' WHEN 2 THEN '' ELSE '.HTML' END AS path,
 'no extractor for this format' AS problem FROM documents WHERE doc_id % 5 IN (1, 2, 3)""",
        "html_anchors_parser": with_ctes(pairs("html", HTML_A, 1, 2), "html"),
        "md_inline_links": with_ctes("SELECT * FROM md_inline", "md", "md_inline"),
        "md_pointy_links": with_ctes("SELECT * FROM md_pointy", "md", "md_pointy"),
        "tex_href_links": with_ctes(pairs("tex", TEX_HREF, 1, 2), "tex"),
        "tex_url_links": with_ctes(pairs("tex", TEX_URL, 1, 1), "tex"),
        "bib_urls": "SELECT '/corpus/' || page_id || '.bib' AS path, CAST(0 AS INTEGER) AS pos, url, 'Key: p' || page_id || ', Field: Url' AS linktext FROM pages",
        "bib_dois": with_ctes("SELECT * FROM dois", "dois"),
        "links_all_formats": with_ctes("SELECT * FROM prose_findings", "prose", "prose_paths", "prose_findings"),
        "prose_scan": f"""SELECT kind, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars,
 CAST(sum(len(regexp_extract_all(text, '{MD_INLINE}', 0)) + len(regexp_extract_all(text, '{MD_POINTY}', 0))) AS BIGINT) AS links
 FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY kind""",
        "scheme_router": r"""SELECT page_id, url, CASE WHEN url IS NULL THEN 'missing' WHEN starts_with(url, 'http') THEN 'http'
 WHEN starts_with(url, 'mailto:') THEN 'mailto' ELSE 'unsupported' END AS scheme
 FROM (SELECT page_id, unnest([url, 'mailto:' || page_id || '@example.com', upper(url), regexp_replace(url, '^https?://[^/]+', ''), NULL]) AS url FROM pages)""",
        "scheme_counts": with_ctes(
            f"SELECT CASE WHEN starts_with(url, 'http') THEN 'http' WHEN starts_with(url, 'mailto:') THEN 'mailto' ELSE 'unsupported' END AS scheme, count(*) AS links FROM ({pairs('html', HTML_A, 1, 2)}) GROUP BY 1",
            "html",
        ),
        "hostname": with_ctes(f"SELECT page_id, spelling, {host('url')} AS hostname FROM spellings", "spellings"),
        "normalize_url": with_ctes(f"SELECT page_id, spelling, url, {norm('url')} AS normalized_url FROM spellings", "spellings"),
        "normalize_query_conflict": with_ctes(
            f"SELECT page_id, spelling, {norm('url', keep_query=True)} AS normalized_url FROM spellings", "spellings"
        ),
        "link_queue": with_ctes("SELECT * FROM queue", *QUEUE),
        "doi_queue": with_ctes("SELECT * FROM dois", "dois"),
        "ignore_urls": with_ctes(
            f"SELECT normalized_url FROM targets WHERE normalized_url NOT IN (SELECT trim(unnest(string_split('{IGNORED}', ','))))",
            *QUEUE, "targets",
        ),
        "rewrite_path": with_ctes(
            "SELECT '/srv/www' || path || '/srv/www/x.md' AS path, 'https://www.example.com' || path || '/srv/www/x.md' AS shown FROM md", "md"
        ),
        "distinct_urls": with_ctes("SELECT DISTINCT normalized_url FROM queue", *QUEUE),
        "url_targets": with_ctes(f"SELECT normalized_url, n_links, {host('normalized_url')} AS hostname FROM targets", *QUEUE, "targets"),
        "distinct_dois": with_ctes("SELECT DISTINCT doi FROM dois", "dois"),
        "prune_cached_links": with_ctes(
            "SELECT * FROM queue q WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.normalized_url = q.normalized_url)",
            *QUEUE, "by_target", "fresh",
        ),
        "prune_cached_dois": with_ctes("SELECT * FROM dois WHERE doi NOT IN (SELECT doi FROM doi_cache)", "dois", "doi_cache"),
        "prune_counts": with_ctes(
            """SELECT count(*) AS rows_before, count(f.normalized_url) AS rows_skipped, count(*) - count(f.normalized_url) AS rows_after
 FROM queue q LEFT JOIN fresh f ON f.normalized_url = q.normalized_url""",
            *QUEUE, "by_target", "fresh",
        ),
        "probe_map": with_ctes(
            """SELECT normalized_url, CAST(CASE length(normalized_url) % 5 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 500 END AS INTEGER) AS status,
 CASE WHEN length(normalized_url) % 5 = 4 THEN 'Timeout' END AS failure FROM targets""",
            *QUEUE, "targets",
        ),
        "probe_join": with_ctes(
            "SELECT t.normalized_url, status, failure FROM targets t LEFT JOIN probe_log l ON t.normalized_url = l.normalized_url",
            *QUEUE, "targets", "by_target", "probe_log",
        ),
        "classify_status": f"""SELECT page_id, status, {OUTCOME} AS outcome, {REASON} AS reason
 FROM (SELECT page_id, CAST(100 + page_id % 500 AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS failure FROM pages)""",
        "classify_failure": f"""SELECT page_id, failure, {OUTCOME} AS outcome, {REASON} AS reason FROM (SELECT page_id, CAST(NULL AS INTEGER) AS status,
 (['Timeout', 'ClientConnectorError', 'ClientResponseError', 'ClientOSError', 'Server disconnected', 'Odd', NULL])[page_id % 7 + 1] AS failure FROM pages)""",
        "verdicts": with_ctes(
            f"SELECT normalized_url, status, outcome, reason, CAST(epoch({BASE_TIME}) AS BIGINT) AS checked_at FROM verdict_new",
            *JUDGED, "fresh", "verdict_new",
        ),
        "classify_doi": with_ctes(f"SELECT doi, status, outcome, CAST(epoch({BASE_TIME}) AS BIGINT) AS checked_at FROM doi_verdicts", *DOIS),
        "upsert_valid_dois": with_ctes(
            f"""SELECT doi, CAST(epoch(last_seen) AS BIGINT) AS last_seen FROM doi_cache UNION ALL
 SELECT doi, CAST(epoch({BASE_TIME}) AS BIGINT) FROM doi_verdicts WHERE outcome = 'valid'""",
            *DOIS,
        ),
        "invalid_dois_by_file": with_ctes(
            "SELECT path, pos, d.doi, description FROM dois d JOIN doi_verdicts v ON d.doi = v.doi WHERE outcome = 'invalid'", *DOIS
        ),
        "refresh_url_cache": with_ctes(
            f"""SELECT normalized_url, CAST(epoch(last_valid) AS BIGINT) AS last_valid FROM fresh UNION ALL
 SELECT normalized_url, CAST(epoch({BASE_TIME}) AS BIGINT) FROM verdict_new WHERE outcome = 'fine'""",
            *JUDGED, "fresh", "verdict_new",
        ),
        "errors_by_code": with_ctes("SELECT normalized_url FROM verdict_all WHERE outcome = 'error' AND status = 404", *JUDGED),
        "count_errors": with_ctes("SELECT count(*) AS num_errors FROM verdict_all WHERE outcome = 'error'", *JUDGED),
        "nested_error_report": with_ctes(
            """SELECT path, n, CAST(pos // 1000 AS INTEGER) AS part, string_agg(url || ' ' || linktext || ' ' || code, '|' ORDER BY pos) AS items
 FROM listing WHERE outcome = 'error' GROUP BY path, n, pos // 1000""",
            *REPORTS,
        ),
        "run_statistics": with_ctes(
            "SELECT (SELECT count(*) FROM queue) AS num_links, count(*) AS num_checked, count(*) FILTER (outcome = 'fine') AS num_fine FROM verdict_all",
            *JUDGED,
        ),
        "report_lines": _report_lines(markdown=True),
        "report_lines_plain": _report_lines(markdown=False),
        "link_audit": with_ctes(
            f"""SELECT path, pos, value AS url, text AS linktext, outcome, coalesce(reason, CAST(status AS VARCHAR)) AS code
 FROM (SELECT *, {norm('value')} AS normalized_url FROM prose_findings WHERE kind = 'link') f
 JOIN prose_verdicts v ON f.normalized_url = v.normalized_url WHERE outcome <> 'fine'""",
            "by_target", "probe_log", "prose", "prose_paths", "prose_findings", "prose_targets", "prose_verdicts",
        ),
        "link_audit_repeat": with_ctes(
            "SELECT normalized_url, n_links, outcome FROM prose_verdicts WHERE outcome <> 'fine'",
            "by_target", "probe_log", "prose", "prose_paths", "prose_findings", "prose_targets", "prose_verdicts",
        ),
        "stream_link_audit": with_ctes(
            f"""SELECT '/corpus/' || page_id || '.tex' AS path, CAST(0 AS INTEGER) AS pos, url,
 CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id ELSE url END AS linktext, outcome, coalesce(reason, CAST(status AS VARCHAR)) AS code
 FROM (SELECT p.page_id, p.url, status, {OUTCOME} AS outcome, {REASON} AS reason FROM (SELECT page_id, url, {norm('url')} AS normalized_url FROM pages) p
 LEFT JOIN probe_log l ON p.normalized_url = l.normalized_url) WHERE outcome <> 'fine'""",
            "by_target", "probe_log",
        ),
    }
    found["links_after_changes"] = found["links_all_formats"]
    found["errors_by_file_hot_urls"] = found["errors_by_file_dealt_urls"] = with_ctes(
        "SELECT path, pos, url, linktext, code FROM defects WHERE outcome = 'error'", *JUDGED, "defects"
    )
    found["error_report_hot_files"] = with_ctes(
        "SELECT path, n, pos, url, linktext, code FROM listing WHERE outcome = 'error'", *REPORTS
    )
    for outcome in ("error", "redirect", "exception"):
        found[f"{outcome}s_by_file"] = with_ctes(
            f"SELECT path, pos, url, linktext, code FROM defects WHERE outcome = '{outcome}'", *JUDGED, "defects"
        )
        found[f"{outcome}_count_by_file"] = with_ctes(
            f"SELECT path, n FROM counts WHERE outcome = '{outcome}'", *JUDGED, "defects", "counts"
        )
        found[f"{outcome}_report"] = with_ctes(
            f"SELECT path, n, pos, url, linktext, code FROM listing WHERE outcome = '{outcome}'", *REPORTS
        )
    return found
