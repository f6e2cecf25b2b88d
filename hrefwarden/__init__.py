"""hrefwarden: audit the hyperlinks and DOIs of a document corpus with Spark."""

from hrefwarden.options import AuditOptions, DeadLinks

__all__ = ["AuditOptions", "DeadLinks"]
__version__ = "0.1.0"
