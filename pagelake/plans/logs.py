"""Log set-up of programs that use the package: Python's logging, one handler, asked for once."""

from __future__ import annotations

import logging
import os

NAME, VARIABLE = "pagelake", "PAGELAKE_LOG"


def init(level: str = "INFO", timestamps: bool = False) -> logging.Logger:
    """The package's logger at a level, writing to stderr; a second call changes the level and adds no handler."""
    log = logging.getLogger(NAME)
    log.setLevel(level.upper())
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.handlers[0].setFormatter(logging.Formatter(("%(asctime)s " if timestamps else "") + "%(levelname)s %(name)s: %(message)s"))
    return log


def init_with_env(otherwise: str = "INFO") -> logging.Logger:
    """At the level that the environment variable PAGELAKE_LOG names, if it names one."""
    level = os.environ.get(VARIABLE, otherwise).upper()
    return init(level if level in logging.getLevelNamesMapping() else otherwise)


def init_debug() -> logging.Logger:
    return init("DEBUG")


def init_with_timestamp(level: str = "INFO") -> logging.Logger:
    return init(level, timestamps=True)
