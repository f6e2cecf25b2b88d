"""Formats, patterns and labels that decide the results.

They are stated as text so that a reader can compare them with the documented
behaviour; everything else in the package is derived from them.
"""

# --- fixed values: file formats -------------------------------------------
HTML_SUFFIXES = (".htm", ".html")
MARKDOWN_SUFFIXES = (".md",)
TEX_SUFFIXES = (".tex",)
BIBTEX_SUFFIXES = (".bib",)
SUPPORTED_SUFFIXES = HTML_SUFFIXES + MARKDOWN_SUFFIXES + TEX_SUFFIXES + BIBTEX_SUFFIXES

FILE_TYPES = {
    "supported": SUPPORTED_SUFFIXES,
    "html": HTML_SUFFIXES,
    "markdown": MARKDOWN_SUFFIXES,
    "tex": TEX_SUFFIXES,
}

# --- fixed values: link patterns (Java regex syntax) ----------------------
# (?U) and the class \x1c-\x1f give \s its Unicode meaning;
# (?d) lets '.' stop at \n only.
MD_INLINE = r"(?iU)\[([^\[]*)\]\(([^\)]*?)[\s\x1c-\x1f\)]+"  # text 1, url 2
MD_NO_END = r"(?U)^[^\s\x1c-\x1f\)]*"  # of the reversed text: what ends no link
MD_POINTY = r"(?i)<([^>]*?)>"  # url = text = 1
TEX_HREF = r"(?id)\\href(?:\[.*\])?\{([^}]*)\}\{([^}]*?)\}"  # url 1, text 2
TEX_URL = r"(?i)\\url\{([^{]*?)\}"  # url = text = 1
HTML_SIMPLE_A = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'  # url 1, text 2
HTML_SIMPLE_HREF = r'(?is)^<a\s[^>]*href="[^"]*"'
HTML_SIMPLE_ENDED = r'(?is)^(?><a\s[^>]*href="[^"]*"[^>]*>).*?</a>'
HTML_SIMPLE_TAGS = r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?(?:</a>|\z)|<a\s[^>]*+>'

# --- fixed values: verdict of an HTTP status or a failure -----------------
FINE_STATUS = (200, 302, 303, 307)
REDIRECT_STATUS = (301, 308)
ERROR_STATUS = (403, 404, 410)
RATE_LIMIT_STATUS = 429
RATE_LIMIT_REASON = "Rate Limit (429)"
KNOWN_FAILURES = (
    "Timeout",
    "ClientConnectorError",
    "ClientResponseError",
    "ClientOSError",
    "Server disconnected",
)
UNCLASSIFIED = "Unclassified"

# --- fixed values: problems while reading a file --------------------------
NOT_FOUND = "file not found"
NO_PERMISSION = "permission error"
READ_TIMEOUT = "system timeout"
BLOCKING_IO = "blocking IO"
NOT_UTF8 = "not valid UTF-8"

# Problems of our own.
NO_EXTRACTOR = "no extractor for this format"

# --- fixed values: texts of the report ------------------------------------
STATUS_MEANING = {403: "Forbidden", 404: "Not Found", 410: "Gone"}
SECTION_TITLES = {
    "access": "FILE ACCESS ERRORS",
    "error": "PERMANENT ERRORS",
    "redirect": "PERMANENT REDIRECTS",
    "exception": "EXCEPTIONS",
}
SECTION_EMPTY = {
    "error": "No permanent errors found!",
    "redirect": "No permanent redirects found!",
    "exception": "No exceptions during the crawl!",
}
TIMESTAMP_FORMAT = "yyyy-MMM-dd HH:mm'h'"
