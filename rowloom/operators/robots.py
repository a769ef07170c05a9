"""robots.txt: parsing, and judging paths by the longest rule that fits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT = "*"


def parse_robots(text: str) -> dict:
    """{"rules": [(agent, path, allow)], "crawl_delay": float, "sitemaps": [...]}. Blank lines, and agents after a rule, end a group."""
    rules, sitemaps, delay, agents, ruled = [], [], 0.0, [], False
    for raw in re.split(r"\r?\n", text or ""):
        line = raw.split("#")[0].strip()
        if not line:
            agents, ruled = [], False
            continue
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
        elif name in ("allow", "disallow"):
            ruled = True
            rules += [(a, value, name == "allow") for a in agents if value]
        elif name == "crawl-delay":
            m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)", value)
            delay = float(m[0]) if m else 0.0
        elif name == "sitemap":
            sitemaps.append(value)
    return {"rules": rules, "crawl_delay": delay, "sitemaps": sitemaps}


def path_pattern(rule: str) -> str:
    """A rule's path as a pattern: * is any run, a final $ the end of the path."""
    anchored = rule.endswith("$")
    body = "".join(".*" if c == "*" else re.sub(r"([^0-9A-Za-z_])", r"\\\1", c) if ord(c) < 128 else c for c in (rule[:-1] if anchored else rule))
    return f"(?s)^{body}" + ("\\z" if anchored else "")


def allowed(path: Column, rules: list[tuple[str, str, bool]], agent: str = AGENT) -> Column:
    """Whether rules let the agent have a path; rules are few enough to be part of the expression."""
    own = [r for r in rules if r[0] == agent.lower()] or [r for r in rules if r[0] == "*"]
    out = F.lit(True)
    for _, rule, allow in sorted(own, key=lambda r: (len(r[1]), r[2])):
        out = F.when(F.rlike(path, F.lit(path_pattern(rule))), F.lit(allow)).otherwise(out)
    return out


def allowed_by_host(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", agent: str = AGENT, key: str = "url_id") -> DataFrame:
    """urls with `allowed`, for rules kept as a table (host, agent, path, allow): an equi-join on host, then the longest fit."""
    wanted = rules.where(F.lower("agent").isin(agent.lower(), "*")).select(F.col("host").alias("__host"), F.lower("agent").alias("__agent"), F.col("path").alias("__rule"), "allow")
    own = wanted.where(F.col("__agent") == agent.lower()).select("__host").distinct()
    general = wanted.where(F.col("__agent") == "*").join(own, "__host", "left_anti").select(*wanted.columns) if agent != "*" else wanted.limit(0)
    used = wanted.where(F.col("__agent") == agent.lower()).unionByName(general)
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace("__rule", r"([^0-9A-Za-z_*])", r"\\$1"), r"\*", ".*"), r"\\\$$", "\\\\z")
    joined = urls.join(used, F.col(host) == F.col("__host"), "left")
    fits = F.coalesce(F.rlike(F.col(path), F.concat(F.lit("(?s)^"), quoted)), F.lit(False))
    best = joined.groupBy(key).agg(F.max(F.when(fits, F.struct(F.length("__rule"), F.col("allow").alias("allow")))).alias("__best"))
    return urls.join(best, key).withColumn("allowed", F.coalesce(F.col("__best.allow"), F.lit(True))).drop("__best")


def origin_of(url: Column) -> Column:
    """scheme://host[:port], lower-cased, or null where that cannot be read."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1), F.lit("")))


def undeclared(df: DataFrame, url: str, origins: list[str]) -> DataFrame:
    """Rows whose origin was not declared."""
    return df.where(~F.coalesce(origin_of(F.col(url)).isin(*[o.lower() for o in origins]), F.lit(False)))
