"""Errors raised on purpose. Those about documents say which: ``failures`` maps paths to reasons."""

from collections.abc import Mapping


class VaultError(Exception):
    """Base of all others."""


class StoreError(VaultError):
    """A store is missing, incomplete or cannot be written."""


class QueryError(VaultError):
    """A query cannot be answered."""


class ToolStartError(VaultError):
    """The tool functions cannot open their store."""


class IngestError(VaultError):
    """Documents cannot be taken in. ``total`` counts them all, ``failures`` holds the first few."""

    def __init__(self, failures: Mapping[str, str], total: int | None = None):
        self.failures = dict(sorted(failures.items()))
        self.total = max(total or 0, len(self.failures))
        shown = "; ".join(f"{path}: {reason}" for path, reason in self.failures.items())
        super().__init__(f"{self.total} failed - {shown}")


class ParseError(IngestError):
    """Documents that cannot be parsed."""
