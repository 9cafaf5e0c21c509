"""Logs of a run: warnings on the console, everything in a file named by the time."""

from __future__ import annotations

import logging
import time
from pathlib import Path


def set_up(folder: str | None = None, level: int = logging.INFO, name: str = "terrafold") -> logging.Logger:
    """The driver's logger.  Set up again, it isn't doubled."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    console = logging.StreamHandler()
    console.setLevel(logging.WARNING)
    handlers: list[logging.Handler] = [console]
    if folder is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / time.strftime(f"{name}_%Y%m%d_%H%M%S.log"), encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    return logger
