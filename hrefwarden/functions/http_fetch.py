"""A plain ``fetch`` for ``verdict.probe``: one GET, redirects not followed, no body read."""

from __future__ import annotations

import http.client
import socket
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from hrefwarden import __version__

_UNQUOTED = "%/:=&?~#+!$,;'@()*[]"


class _FirstAnswer(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def http_fetch(timeout: float = 5.0, user_agent: str = f"hrefwarden/{__version__}") -> Callable:
    """fetch(url) -> (status, failure); exactly one of them is not None."""

    def fetch(url: str) -> tuple[int | None, str | None]:
        request = urllib.request.Request(
            urllib.parse.quote(url, safe=_UNQUOTED), headers={"User-Agent": user_agent}
        )
        try:
            with urllib.request.build_opener(_FirstAnswer).open(request, timeout=timeout) as answer:
                return answer.status, None
        except urllib.error.HTTPError as answer:
            return answer.code, None
        except Exception as error:
            return None, failure_name(error)

    return fetch


def failure_name(error: BaseException) -> str:
    """The failure under which an error is reported."""
    if isinstance(error, urllib.error.URLError):
        inner = error.reason if isinstance(error.reason, BaseException) else None
        if isinstance(inner, (TimeoutError, http.client.RemoteDisconnected)):
            return failure_name(inner)
        return "ClientConnectorError"
    if isinstance(error, TimeoutError):
        return "Timeout"
    if isinstance(error, http.client.RemoteDisconnected):
        return "Server disconnected"
    if isinstance(error, (socket.gaierror, ConnectionRefusedError)):
        return "ClientConnectorError"
    if isinstance(error, http.client.HTTPException):
        return "ClientResponseError"
    if isinstance(error, OSError):
        return "ClientOSError"
    return type(error).__name__
