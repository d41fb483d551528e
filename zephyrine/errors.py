"""Errors of the engine, and the guard for optional dependencies."""

from __future__ import annotations

import importlib
import logging
import os
import warnings


class EngineError(Exception):
    """Base of all errors raised here."""


class DataError(EngineError):
    pass


class ModelError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class ExperimentalWarning(UserWarning):
    """An operator whose results may change."""


def warn_experimental(name: str) -> None:
    warnings.warn(f"{name} is experimental", ExperimentalWarning, stacklevel=3)


def require(name: str):
    """An optional module, or with ``module:object`` an object of it."""
    module, _, obj = name.partition(":")
    try:
        m = importlib.import_module(module)
    except ImportError as e:
        raise ConfigError(f"{module} is needed here but isn't installed") from e
    return getattr(m, obj) if obj else m


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger("zephyrine" + (f".{name}" if name else ""))


def enable_logging(level: str | None = None) -> logging.Logger:
    """One console handler; level from the argument, else ZEPHYRINE_LOG, else info."""
    log = get_logger()
    log.setLevel((level or os.environ.get("ZEPHYRINE_LOG") or "info").upper())
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    return log
