"""Messages by verbosity: 0 none, 1 what is done, 2 with figures, 3 all."""

from __future__ import annotations

import logging

LEVELS = (logging.CRITICAL + 1, logging.INFO, logging.DEBUG, 1)
logger = logging.getLogger("cirrostrat")


def set_verbosity(level: int) -> None:
    logger.setLevel(LEVELS[max(0, min(int(level), 3))])
    if not logger.handlers:
        logger.addHandler(logging.StreamHandler())


def say(level: int, message: str, *values) -> None:
    if level > 0:
        logger.log(LEVELS[min(level, 3)], message, *values)
