"""Records from pasted content: structured data first, then marked-up properties, then plain text. A small vectorised helper."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "title string, ingredients array<string>, steps array<string>, origin string"
_LD = re.compile(r"""<script[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script>""", re.I | re.S)
_HEAD = re.compile(r"^\W*(ingredients?|method|directions?|instructions?|steps|preparation)\W*$", re.I)
_AMOUNT = re.compile(r"^\W*(\d|[½⅓⅔¼¾⅛]|an? |one |two |three |half |pinch|dash|handful)", re.I)
_SPACE = re.compile(r"\s+")


def _flat(text: object) -> str:
    return _SPACE.sub(" ", re.sub(r"<[^>]*>", " ", str(text))).strip()


def flatten_steps(value: object, keep_sections: bool = True) -> list[str]:
    """Instructions as text, list, steps or sections of steps; a section's name stands before its steps or is left out."""
    if isinstance(value, str):
        return [s for s in (_flat(x) for x in re.split(r"\n+|<br */?>|</p>", value)) if s]
    if isinstance(value, list):
        return [s for x in value for s in flatten_steps(x, keep_sections)]
    if isinstance(value, dict):
        inner = value.get("itemListElement")
        if inner is not None:
            name = [_flat(value["name"])] if keep_sections and value.get("name") else []
            return name + flatten_steps(inner, keep_sections)
        return flatten_steps(value.get("text") or value.get("name") or "", keep_sections)
    return []


def from_json_ld(page: str) -> dict | None:
    """The first recipe of the page's blocks; lists and graphs are looked into, broken blocks passed over."""
    for block in _LD.findall(page):
        try:
            open_ = [json.loads(block)]
        except ValueError:
            continue
        while open_:
            x = open_.pop(0)
            if isinstance(x, list):
                open_ = x + open_
            elif isinstance(x, dict):
                kind = x.get("@type")
                if kind == "Recipe" or isinstance(kind, list) and "Recipe" in kind:
                    return {"title": _flat(x.get("name") or ""), "ingredients": [_flat(i) for i in x.get("recipeIngredient") or x.get("ingredients") or []], "steps": flatten_steps(x.get("recipeInstructions")), "origin": "json-ld"}
                open_ += [x[k] for k in ("@graph", "mainEntity") if k in x]
    return None


class _Properties(HTMLParser):
    """Texts of itemprop elements inside the first Recipe scope; a nested scope's own properties do not count."""

    def __init__(self):
        super().__init__()
        self.found: dict[str, list[str]] = {}
        self.depth, self.scopes, self.open = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"):
            a = dict(attrs)
            if self.inside and a.get("itemprop") and a.get("content"):
                self.found.setdefault(a["itemprop"], []).append(a["content"])
            return
        self.depth += 1
        a = dict(attrs)
        if a.get("itemprop") and self.inside and "itemscope" not in a:
            self.open.append((self.depth, a["itemprop"], []))
        if "itemscope" in a:
            self.scopes.append((self.depth, "Recipe" in (a.get("itemtype") or "")))

    @property
    def inside(self) -> bool:
        return bool(self.scopes) and self.scopes[-1][1]

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == self.depth:
            _, name, parts = self.open.pop()
            self.found.setdefault(name, []).append(_flat(" ".join(parts)))
        if self.scopes and self.scopes[-1][0] == self.depth:
            self.scopes.pop()
        self.depth = max(0, self.depth - 1)


def from_properties(page: str) -> dict | None:
    reader = _Properties()
    reader.feed(page)
    got = reader.found
    items = got.get("recipeIngredient") or got.get("ingredients")
    if not items:
        return None
    return {"title": (got.get("name") or [""])[0], "ingredients": items, "steps": got.get("recipeInstructions") or [], "origin": "microdata"}


def from_text(text: str) -> dict | None:
    """Under headings where there are any, else by the lines' shape: short lines that begin with an amount are ingredients."""
    lines = [x for x in (_SPACE.sub(" ", y).strip() for y in text.split("\n")) if x]
    if not lines:
        return None
    title, items, steps, part = "", [], [], None
    headed = any(_HEAD.match(x) for x in lines)
    for x in lines:
        m = _HEAD.match(x)
        if m:
            part = items if m[1].lower().startswith("ingredient") else steps
        elif headed and part is not None:
            part.append(x)
        elif not title and not _AMOUNT.match(x):
            title = x
        elif not headed:
            (items if _AMOUNT.match(x) and len(x) < 80 and not x.endswith(".") else steps).append(x)
    return {"title": title, "ingredients": items, "steps": steps, "origin": "text"} if items or steps else None


def parse_content(content: str | None) -> dict:
    found = None
    if content and re.search(r"<\w+[^>]*>", content):
        found = from_json_ld(content) or from_properties(content)
    elif content:
        found = from_text(content)
    return found or {"title": None, "ingredients": [], "steps": [], "origin": None}


def _parsed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_content(x) for x in content], columns=["title", "ingredients", "steps", "origin"])


def imported(content: Column) -> Column:
    return F.pandas_udf(_parsed, SCHEMA)(content)
