"""Failures that stop a whole job (per-request outcomes are ``error_code``
columns instead, see ``config``)."""

from __future__ import annotations

from . import config


class RegistryNotFound(RuntimeError):
    """The registry root does not exist (a mistyped path must not look like an empty registry)."""

    def __init__(self, root: str):
        self.root = root
        super().__init__(f"no registry at '{root}'")


class DataFetchError(RuntimeError):
    """The price source could not be read at all (``DATA_FETCH_FAILED``)."""

    code = config.DATA_FETCH_FAILED

    def __init__(self, source: str, original: Exception):
        self.source = source
        self.original = original
        super().__init__(f"Failed to fetch price data from '{source}': {original}")
