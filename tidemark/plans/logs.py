"""Log lines of runs: as text, or as one JSON object each."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

#: What an engine's lines carry besides their message.
KEYS = ("target", "runId", "page", "group")


class TextFormatter(logging.Formatter):
    """Time, level, ``[target run page group]`` as far as known, message."""

    def format(self, record: logging.LogRecord) -> str:
        known = " ".join(f"{k}={v}" for k in KEYS if (v := getattr(record, k, None)) is not None)
        text = f"{self.formatTime(record)} {record.levelname} [{known}] {record.getMessage()}"
        return text + ("\n" + self.formatException(record.exc_info) if record.exc_info else "")


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        line = {"time": at, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k in (*KEYS, "told") if (v := getattr(record, k, None)) is not None}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def log_to(handler: logging.Handler, as_json: bool = False, level: int = logging.INFO) -> None:
    handler.setFormatter(JsonFormatter() if as_json else TextFormatter())
    logger = logging.getLogger("tidemark")
    logger.addHandler(handler)
    logger.setLevel(level)
