"""Logging for command-line and notebook use: plain, detailed or JSON lines."""

from __future__ import annotations

import json
import logging

FORMATS = {"simple": "%(levelname)s %(message)s", "detailed": "%(asctime)s %(name)s %(levelname)s %(message)s"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "name": record.name, "level": record.levelname, "message": record.getMessage()})


def set_up(level: str = "INFO", style: str = "simple") -> logging.Logger:
    """Configure and return the package's logger."""
    logger = logging.getLogger("meshwork")
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if style == "json" else logging.Formatter(FORMATS[style]))
    logger.handlers = [handler]
    logger.setLevel(level)
    return logger
