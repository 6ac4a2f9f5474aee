"""Log lines with a level and a category, over Python's own logging: one logger a category, one format for all.

``[2026-01-02 03:04:05.678] [INFO ] [compaction] [TID:140] store.py:12 publish: message``
"""

from __future__ import annotations

import logging
import time
from collections import deque

TRACE = 5
#: The names of levels and categories in a line.
LEVELS = {TRACE: "TRACE", logging.DEBUG: "DEBUG", logging.INFO: "INFO ", logging.WARNING: "WARN ", logging.ERROR: "ERROR", logging.CRITICAL: "FATAL"}
CATEGORIES = ("general", "wal", "sstable", "memtable", "compaction", "io")

_ROOT = "cellweave"
logging.getLogger(_ROOT).addHandler(logging.NullHandler())


def level_name(level: int) -> str:
    return LEVELS.get(level, "UNKNOW")


def category_name(logger: str) -> str:
    last = logger.rpartition(".")[2]
    return last if last in CATEGORIES else "unknown"


def logger(category: str) -> logging.Logger:
    """The logger of a category; one that is not known is logged as ``unknown``."""
    return logging.getLogger(f"{_ROOT}.{category}")


class LineFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(int(record.created)))
        head = f"[{stamp}.{int(record.created * 1000) % 1000:03d}] [{level_name(record.levelno)}] [{category_name(record.name)}] [TID:{record.thread}]"
        line = f"{head} {record.filename}:{record.lineno} {record.funcName}: {record.getMessage()}"
        return f"{line}\n{self.formatException(record.exc_info)}" if record.exc_info else line


class RingHandler(logging.Handler):
    """Keeps the last lines, to be written out when something fails."""

    def __init__(self, lines: int = 1000):
        super().__init__()
        self.lines: deque[str] = deque(maxlen=lines)
        self.setFormatter(LineFormatter())

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


def configure(level: int = logging.INFO, categories: dict[str, int] | None = None, handler: logging.Handler | None = None) -> logging.Handler:
    """Sends all categories to a handler (the console if none is given); ``categories`` have levels of their own."""
    handler = handler or logging.StreamHandler()
    handler.setFormatter(LineFormatter())
    root = logging.getLogger(_ROOT)
    root.addHandler(handler)
    root.setLevel(level)
    for c, own in (categories or {}).items():
        logger(c).setLevel(own)
    return handler
