"""The registry of pipeline steps and the limits they share."""

from __future__ import annotations

import copy

#: Steps that work on data, with their default configuration (fixed values).
DATA_STEPS = {
    "WEBSITE": {"url": "https://", "wait": True, "timeoutMs": 30000}, "NAVIGATE": {"url": "https://", "wait": True, "timeoutMs": 30000}, "WAIT": {"ms": 1000}, "IF_ELSE": {"condition": "exists", "selector": "", "value": ""},
    "LOOP": {"type": "elements", "selector": "", "max": 0}, "PAGINATE": {"selector": "", "maxPages": 10}, "ASSERT": {"assertion": "exists", "selector": ""}, "DEDUPE": {"fields": "", "scope": "run"}, "EXTRACT": {"fields": []},
    "PAGE_DATA": {"source": "auto", "type": "", "flatten": False}, "PAGE_JSON": {"mode": "tree", "selector": "", "includeScripts": False}, "DOWNLOAD_FILE": {"selector": "", "filename": "{{file.name}}"}, "EXPORT": {"format": "csv", "append": False},
    "API": {"url": "", "rowsPath": ""}, "API_SNIFFER": {"enabled": True, "urlFilter": "", "methods": ""}, "PDF_EXTRACTION": {"mode": "text", "hasHeader": True, "maxPages": 50}, "AUTO_EXTRACT": {"schema": "", "threshold": 70},
}
#: Steps that act on a live browser, or on credentials: part of the language, refused by name when a plan is made.
BROWSER_STEPS = ("CLICK", "FILL", "HOVER", "SELECT", "SCROLL", "KEYBOARD", "DRAG_DROP", "UPLOAD_ACTIVITY", "SCREENSHOT", "SOLVE_CAPTCHA", "SESSION", "SET_HEADERS")
INTERNAL_STEPS = ("TYPE", "QUERY_COUNT", "QUERY_ELEMENTS", "PAGE_METRICS", "SCROLL_TO", "ELEMENT_BOX", "DOWNLOAD_COLLECT", "SESSION_STORAGE", "PAGINATE_PROBE")
NOT_EXPORTABLE = ("UPLOAD_ACTIVITY", "SOLVE_CAPTCHA", "SET_HEADERS", "SESSION", "PAGE_JSON", "API_SNIFFER", "PDF_EXTRACTION", "AUTO_EXTRACT")
USER_STEPS = (*DATA_STEPS, *BROWSER_STEPS)

MOST_RETRIES, MOST_RETRY_MS, RETRY_MS = 5, 30_000, 500
LOOP_CAP = 10_000


def is_known(kind: object) -> bool:
    return str(kind or "") in USER_STEPS or str(kind or "") in INTERNAL_STEPS


def is_exportable(kind: str) -> bool:
    return is_known(kind) and kind not in NOT_EXPORTABLE


def default_config(kind: str) -> dict:
    if not is_known(kind):
        raise ValueError(f"Unknown step type: {kind}")
    return copy.deepcopy(DATA_STEPS.get(kind, {}))


def _number(value: object) -> float | None:
    try:
        n = float(value)
    except (TypeError, ValueError):
        return None
    return n if n == n and abs(n) != float("inf") else None


def retry_count(config: dict | None) -> int:
    n = _number((config or {}).get("retries"))
    return 0 if n is None or n < 1 else min(int(n), MOST_RETRIES)


def retry_delay_ms(config: dict | None) -> int:
    n = _number((config or {}).get("retryDelayMs"))
    return RETRY_MS if n is None or n < 0 else int(min(n, MOST_RETRY_MS))
