"""robots.txt: groups, rules, delays, sitemaps, and whether a path is allowed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow

MOST_BYTES, MOST_DELAY = 512 << 10, 3600.0


def parse_robots(text: str | None, agent: str = "siftline") -> dict:
    """The rules that hold for an agent: those of groups that name it if they have any, else those of `*`."""
    text = (text or "").encode()[:MOST_BYTES].decode("utf-8", "ignore").lstrip("﻿")
    groups: list[dict] = []
    sitemaps: list[str] = []
    naming = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "user-agent":
            if not naming:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            naming = True
        elif groups:
            naming = False
            if key in ("allow", "disallow") and value:
                groups[-1]["rules"].append((key == "allow", value))
            elif key == "crawl-delay":
                try:
                    groups[-1]["delay"] = min(float(value), MOST_DELAY) if float(value) >= 0 else None
                except ValueError:
                    pass
        else:
            naming = False
    own = [g for g in groups if any(a != "*" and a in agent.lower() for a in g["agents"])]
    if not any(g["rules"] or g["delay"] is not None for g in own):
        own = [g for g in groups if "*" in g["agents"]]
    return {"rules": [r for g in own for r in g["rules"]], "delay": next((g["delay"] for g in own if g["delay"] is not None), None), "sitemaps": sitemaps}


def _fits(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in pattern.removesuffix("$").split("*"))
    return re.match(body + ("$" if end else ""), path, re.S) is not None


def allowed(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest fitting pattern decides, allowing on a tie; without one everything is allowed."""
    fitting = [(len(p.encode()), a) for a, p in rules if _fits(p, path)]
    return max(fitting)[1] if fitting else True


def allowed_by(status: int | None, text: str | None, path: str, agent: str = "siftline") -> bool:
    """As above, after the reply: missing files allow all, other failures nothing."""
    if status in (404, 410):
        return True
    if status is None or not 200 <= status < 300:
        return False
    return allowed(parse_robots(text, agent)["rules"], path)


@arrow("boolean")
def may_fetch(status: pd.Series, text: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([allowed_by(None if pd.isna(s) else int(s), t, p) for s, t, p in zip(status, text, path)])
