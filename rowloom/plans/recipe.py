"""Recipes: reading them, checking them, and what they would do."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from rowloom.plans.steps import BROWSER_STEPS, INTERNAL_STEPS, is_exportable, is_known

BRANCHES = ("children", "ifBranch", "elseBranch")
FILE_VARIABLES = ("file.name", "file.stem", "file.ext", "file.index", "file.host")
_TEMPLATE = re.compile(r"\{\{([^}]+)\}\}")
_SECRET_KEY = re.compile(r"pass(word)?|secret|token|api[-_]?key|\bkey\b|cred|auth|bearer", re.I)
_SECRET_HEADER = re.compile(r"(authorization|proxy-authorization|x-api-key|api-key|x-auth-token|cookie)\Z", re.I)
_PASSWORD_FIELD = re.compile(r"type\s*=\s*[\"']?password|#pass|\bpassword\b|\bpwd\b", re.I)
_AUTH_HEADERS = ("authorization", "cookie", "x-api-key", "x-auth-token", "authentication", "proxy-authorization")


@dataclass
class Step:
    id: str
    type: str
    label: str
    config: dict
    children: list[Step] | None = None
    ifBranch: list[Step] | None = None
    elseBranch: list[Step] | None = None

    def below(self) -> Iterator[Step]:
        for name in BRANCHES:
            yield from walk(getattr(self, name) or [])


@dataclass
class Recipe:
    name: str
    version: str
    target_origin: str
    steps: list[Step]
    errors: list[str] = field(default_factory=list)


def walk(steps: list[Step]) -> Iterator[Step]:
    """Every step, in order, with those inside loops and branches."""
    for s in steps:
        yield s
        yield from s.below()


def read_recipe(given: object) -> Recipe:
    """A recipe from its JSON form; what is wrong with it is in errors."""
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            given = None
    if not isinstance(given, dict):
        return Recipe("Untitled", "", "", [], ["Pipeline must be an object"])
    if not isinstance(given.get("steps"), list):
        return Recipe(given.get("name") or "Untitled", "", "", [], ["Pipeline must have a steps array"])
    errors: list[str] = []

    def build(items: list) -> list[Step]:
        out = []
        for i, s in enumerate(items):
            if not isinstance(s, dict) or not s.get("type"):
                errors.append(f"Step {i + 1} is missing a type")
                s = s if isinstance(s, dict) else {}
            kind = str(s.get("type") or "").upper()
            nested = {b: build(s[b]) for b in BRANCHES if isinstance(s.get(b), list)}
            out.append(Step(str(s.get("id") or f"step_{i + 1}"), kind, str(s.get("label") or s.get("type") or f"Step {i + 1}"), copy.deepcopy(s.get("config") or {}), **nested))
        return out

    steps = build(given["steps"])
    return Recipe(given.get("name") or "Untitled", str(given.get("version") or "1"), given.get("targetOrigin") or "", steps, errors)


def unrunnable(recipe: Recipe) -> list[tuple[str, str, str]]:
    """(id, type, reason) of the steps that no plan can be made of."""
    out = []
    for s in walk(recipe.steps):
        if s.type in BROWSER_STEPS or s.type in INTERNAL_STEPS:
            out.append((s.id, s.type, "acts on a live browser and has no equivalent over data"))
        elif not is_known(s.type):
            out.append((s.id, s.type, "unknown step type"))
    return out


def unexportable(recipe: Recipe) -> list[tuple[str, str, str]]:
    return [(s.id, s.type, "runs inside the application and has no standalone equivalent" if is_known(s.type) else "unknown step type") for s in walk(recipe.steps) if not is_exportable(s.type)]


def _strings(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict | list):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from _strings(v, f"{path}.{k}")


def unresolved_templates(recipe: Recipe) -> list[dict]:
    """Templates in configurations, but for those of a download's own file name."""
    out = []
    for s in walk(recipe.steps):
        for path, text in _strings(s.config, "config"):
            for m in _TEMPLATE.finditer(text):
                if not (s.type == "DOWNLOAD_FILE" and path == "config.filename" and m[1].strip() in FILE_VARIABLES):
                    out.append({"stepId": s.id, "type": s.type, "where": path, "template": m[0]})
    return out


def filename_template(template: str) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """Segments of (lit or var, text) parts, and the variables that a file name cannot have."""
    segments, unsupported = [], []
    for segment in filter(None, (s.strip() for s in (template or "").split("/"))):
        parts = []
        for i, piece in enumerate(_TEMPLATE.split(segment)):
            if i % 2 == 0:
                parts += [("lit", piece)] if piece else []
            elif piece.strip() in FILE_VARIABLES:
                parts.append(("var", piece.strip()))
            else:
                unsupported.append("{{" + piece + "}}")
        segments.append(parts)
    return segments, unsupported


def redact(recipe: Recipe) -> tuple[Recipe, list[dict]]:
    """A copy with secrets replaced by markers, and which there were."""
    out, found = copy.deepcopy(recipe), []

    def claim(s: Step, where: str) -> str:
        name = f"SECRET_{len(found) + 1}"
        found.append({"env": name, "stepId": s.id, "type": s.type, "where": where})
        return f"__ENV__{name}__"

    def clean(s: Step, config: dict | list, path: str) -> None:
        for k, v in config.items() if isinstance(config, dict) else enumerate(config):
            if isinstance(v, dict | list):
                clean(s, v, f"{path}.{k}")
            elif isinstance(v, str) and v and _SECRET_KEY.search(str(k)):
                config[k] = claim(s, f"{path}.{k}")

    for s in walk(out.steps):
        if s.type == "API" and isinstance(s.config.get("headers"), str):
            try:
                headers = json.loads(s.config["headers"])
            except ValueError:
                headers = None
            if isinstance(headers, dict):
                secret = [k for k, v in headers.items() if _SECRET_HEADER.match(k) and isinstance(v, str) and v]
                headers |= {k: claim(s, f"headers.{k}") for k in secret}
                s.config["headers"] = json.dumps(headers) if secret else s.config["headers"]
        if s.type in ("FILL", "TYPE"):
            if s.config.get("text") and _PASSWORD_FIELD.search(str(s.config.get("selector") or "")):
                s.config["text"] = claim(s, "config.text")
            for f in s.config.get("fields") or []:
                if f.get("value") and _PASSWORD_FIELD.search(str(f.get("selector") or "")):
                    f["value"] = claim(s, f"fields[{f.get('selector')}]")
        clean(s, s.config, "config")
    return out, found


def origin_of(url: object) -> str | None:
    """The origin of an address that is known before a run, or None."""
    text = str(url or "").strip()
    if re.search(r"\{\{|\$\{", "/".join(text.split("/")[:3])):
        return None
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        return None
    shown = f":{port}" if port and port != {"http": 80, "https": 443}[parts.scheme.lower()] else ""
    return f"{parts.scheme.lower()}://{parts.hostname.lower()}{shown}"


def declared_origins(recipe: Recipe) -> list[str]:
    urls = [recipe.target_origin, *(s.config.get("url") for s in walk(recipe.steps) if s.type in ("WEBSITE", "NAVIGATE"))]
    return list(dict.fromkeys(filter(None, map(origin_of, urls))))


def _header_names(raw: object) -> list[str]:
    try:
        parsed = json.loads(raw) if isinstance(raw, str) else raw
    except ValueError:
        parsed = None
    if isinstance(parsed, dict):
        return list(parsed)
    return [n for n in (line.split(":")[0].strip() for line in str(raw or "").split("\n")) if n]


def capabilities(recipe: Recipe) -> dict:
    """What a recipe can do, the sites it sends to, and whether it is allowed, to be reviewed, or blocked.

    Blocked is what reads a session or sends credentials and also talks to a site that it does not say it reads.
    """
    declared, outside, found = declared_origins(recipe), [], {}
    credentials = False

    def add(name: str, severity: str, s: Step) -> None:
        found.setdefault(name, {"id": name, "severity": severity, "steps": []})["steps"].append(s.id)

    for s in walk(recipe.steps):
        if s.type == "SESSION":
            credentials |= s.config.get("includeCookies") is not False or s.config.get("includeStorage") is not False
            add("credentials", "danger", s)
        elif s.type == "SET_HEADERS":
            auth = any(n.lower() in _AUTH_HEADERS for n in _header_names(s.config.get("headers")))
            credentials |= auth
            add("headers", "danger" if auth else "notice", s)
        elif s.type == "API" or (s.type == "DOWNLOAD_FILE" and s.config.get("url")):
            origin = origin_of(s.config.get("url"))
            off_site = origin not in declared
            outside += [origin or "(decided at run time)"] if off_site else []
            add("network", "danger" if off_site else "notice", s)
        elif s.type in ("UPLOAD_ACTIVITY", "SOLVE_CAPTCHA", "AUTO_EXTRACT", "EXPORT"):
            name, severity = {"UPLOAD_ACTIVITY": ("upload", "danger"), "SOLVE_CAPTCHA": ("captcha", "danger"), "AUTO_EXTRACT": ("ai", "notice"), "EXPORT": ("export", "info")}[s.type]
            add(name, severity, s)
    outside = list(dict.fromkeys(outside))
    harmless = all(c["severity"] == "info" for c in found.values())
    verdict = "blocked" if credentials and outside else "allow" if harmless else "review"
    return {"verdict": verdict, "capabilities": list(found.values()), "declared": declared, "thirdParty": outside}


def count_requests(steps: list[Step], kinds: tuple[str, ...] = ("WEBSITE", "NAVIGATE", "API", "DOWNLOAD_FILE", "PAGINATE", "CLICK")) -> int:
    """Requests that a run would make: loops multiply (by 10 where their length is not known), the larger branch counts."""
    total = 0
    for s in steps:
        own = int(s.type in kinds)
        if s.type == "LOOP":
            times = s.config.get("count") or s.config.get("max") or s.config.get("iterations") or 10
            total += own + max(1, int(times)) * count_requests(s.children or [], kinds)
        elif s.type == "IF_ELSE":
            total += own + max(count_requests(s.ifBranch or [], kinds), count_requests(s.elseBranch or [], kinds))
        else:
            total += own + count_requests(s.children or [], kinds)
    return total


def gates(recipe: Recipe, robots_rules: list | None = None) -> list[dict]:
    """Warnings before a run: robots rules, pace, captchas, other origins, and form filling, which is refused."""
    from rowloom.operators.robots import path_pattern

    out = []
    own = [r for r in robots_rules or [] if r[0] == "*"]
    for s in walk(recipe.steps):
        if s.type in ("WEBSITE", "NAVIGATE") and own:
            path = urlsplit(str(s.config.get("url") or "")).path or "/"
            fits = [(len(p), allow) for _, p, allow in own if re.search(path_pattern(p).replace("\\z", "\\Z"), path)]
            if fits and not max(fits)[1]:
                out.append({"code": "ROBOTS", "severity": "warn", "message": f"robots.txt disallows {path}."})
    requests = count_requests(recipe.steps)
    if requests > 100:
        out.append({"code": "RATE", "severity": "warn", "message": f"This pipeline makes about {requests} requests; they are paced at one a second after a burst of ten."})
    if any(s.type == "SOLVE_CAPTCHA" for s in walk(recipe.steps)):
        out.append({"code": "CAPTCHA", "severity": "block", "message": "Captchas are not answered here."})
    report = capabilities(recipe)
    if report["thirdParty"]:
        out.append({"code": "ORIGIN", "severity": "warn" if report["verdict"] != "blocked" else "block", "message": f"Sends requests to {', '.join(report['thirdParty'])}, which it does not declare."})
    if any(s.type == "FILL" for s in walk(recipe.steps)):
        out.append({"code": "FORM_FILL", "severity": "block", "message": "Forms are not filled here."})
    return out
