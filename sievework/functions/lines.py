"""A grammar of amount lines (`1 1/2 cups flour, sifted`): a tokeniser, and a state machine over token classes that a table drives.

A line is cleaned (any numeric glyph, dash or full-width digit; misread UTF-8),
its brackets are taken out, and its front is read token by token: the table says
for a state and a class which step to take and where that leads; a class that
the table does not name ends the amount, and the rest is the name. What follows
a comma is preparation where a word of it tells so, else a note.

`parse_lines` runs the grammar once for each distinct line and joins the results
back, `parse_line` on a column as it is. Headers, empty lines and lines of signs
alone have no parts.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units by what they measure, with their spellings but for plurals. Classes: p may follow the name, f leads it only, i means one where no number stands, c holds a size ("2 (14 oz) cans").
_UNITS = (
    ("g", "", "g gm gr gram gramme 克"), ("kg", "", "kg kilo kilogram kilogramme 千克 公斤"), ("mg", "", "mg milligram"), ("ml", "", "ml millilitre milliliter cc 毫升"), ("l", "", "l litre liter ltr 升"),
    ("tsp", "", "tsp teaspoon teaspoonful tspn 小勺 茶匙 小匙"), ("tbsp", "", "tbsp tbs tbl tblsp tablespoon tablespoonful 大勺 汤匙 大匙"), ("cup", "", "cup c cupful 杯"), ("fl oz", "", "fl_oz floz fluid_ounce fluid_oz fl_ounce"),
    ("oz", "", "oz ounce"), ("lb", "", "lb pound"), ("pint", "", "pint pt"), ("quart", "", "quart qt"), ("gallon", "", "gallon gal"),
    ("pinch", "i", "pinch smidgen"), ("dash", "i", "dash"), ("drop", "i", "drop"), ("splash", "i", "splash glug"), ("drizzle", "i", "drizzle"), ("handful", "i", "handful"), ("knob", "i", "knob"), ("scoop", "i", "scoop"),
    ("clove", "pi", "clove 瓣"), ("sprig", "pi", "sprig"), ("stalk", "pi", "stalk rib"), ("ear", "pf", "ear"), ("slice", "i", "slice strip rasher 片"), ("bunch", "i", "bunch bundle 把"), ("head", "if", "head"),
    ("can", "ic", "can tin 罐"), ("jar", "ic", "jar"), ("bottle", "ic", "bottle"), ("package", "ic", "package pkg packet pack envelope sachet carton container tub punnet pouch 包 袋"), ("box", "ic", "box 盒"), ("bag", "ic", "bag"),
    ("stick", "ifc", "stick"), ("loaf", "ifc", "loaf"), ("piece", "ic", "piece pc 个 只 块 段 颗 粒 根 条"), ("sheet", "if", "sheet"), ("leaf", "f", "leaf"), ("cube", "if", "cube"), ("inch", "f", "inch"), ("square", "f", "square"),
)
# Units told by their letter's case; factors to ml or g; words for numbers; words that say how large or how near an amount is.
_CASED = {"T": "tbsp", "Tb": "tbsp", "TB": "tbsp", "t": "tsp", "C": "cup", "c": "cup"}
_FACTORS = {"ml": ("volume", 1.0), "l": ("volume", 1000.0), "tsp": ("volume", 4.92892), "tbsp": ("volume", 14.7868), "cup": ("volume", 236.588), "fl oz": ("volume", 29.5735), "pint": ("volume", 473.176), "quart": ("volume", 946.353), "gallon": ("volume", 3785.41), "g": ("mass", 1.0), "kg": ("mass", 1000.0), "mg": ("mass", 0.001), "oz": ("mass", 28.3495), "lb": ("mass", 453.592)}
_NUMBERS = {w: float(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1.0, "an": 1.0, "half": 0.5, "quarter": 0.25, "couple": 2.0}
_SIZES = frozenset("small medium large big jumbo extra-large heaping heaped level scant generous rounded".split())
_NEAR = frozenset("about approximately approx around roughly".split())
_FRUIT = ("juice", "zest", "rind", "peel")
_PREPARED = frozenset("cut beaten drained ground torn split sifted thawed melted frozen thinly finely coarsely roughly freshly lightly well room halved quartered rinsed skin".split())
_TASTE = re.compile(r"(?i)\b(?:to|for) (?:taste|garnish|serving)\b|\bas needed\b|适量|少许")
_OPTIONAL = re.compile(r"(?i)\boptional(?:ly)?\b|\bif (?:desired|using|you like)\b")
_IRREGULAR = {"leaf": "leaves", "loaf": "loaves", "handful": "handfuls", "inch": "inches", "half": "halves"}


def _plural(word: str) -> str:
    return _IRREGULAR.get(word) or word + ("es" if word.endswith(("ch", "sh", "x")) else "s")


_SPELLED = {form: name for name, _, forms in _UNITS for word in forms.split() for form in ((word, _plural(word)) if word[0].isascii() else (word,))}
_SINGULAR = frozenset(word for _, _, forms in _UNITS for word in forms.split())
_CLASS = {name: kinds for name, kinds, _ in _UNITS}
FIELDS = ("qty", "qty_max", "unit", "pack_qty", "pack_max", "pack_unit", "size", "name", "prep", "note", "optional")
SCHEMA = "qty double, qty_max double, unit string, pack_qty double, pack_max double, pack_unit string, size string, name string, prep string, note string, optional boolean"
_TOKEN = re.compile(r"(?P<frac>\d+\s*/\s*\d+)|(?P<num>\d+\.\d+|\.\d+|\d+)|(?P<range>-|\bto\b)|(?P<plus>\+|\bplus\b)|(?P<comma>[,;])|(?P<word>[^\s,;\d+-][^\s,;\d]*(?:-[^\s,;\d-]+)*)|(?P<other>\S)", re.I)


def clean(line: str | None) -> str:
    """One line of plain text: misread UTF-8 undone, numeric glyphs as fractions, one kind of dash and blank, no bullet."""
    text = line or ""
    if "Ã" in text or "Â" in text or "â" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            text = text.replace("Â", "")
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if kind == "No" and (value := unicodedata.numeric(ch, None)) is not None and value % 1:
            out.append(f" {Fraction(value).limit_denominator(16)} ")
        elif kind == "Nd":
            out.append(str(unicodedata.digit(ch)))
        elif kind == "Pd" or ch == "−":
            out.append("-")
        elif ch in "⁄∕":
            out.append("/")
        elif ch in "‘’":
            out.append("'")
        elif kind in ("Zs", "Cc", "Cf", "Zl", "Zp"):
            out.append(" ")
        else:
            out.append(ch)
    text = re.sub(r"^[\s•·*▢◦‣-]+(?=\D)", "", "".join(out))
    text = re.sub(r"(?i)(?<![a-z])s\s*&\s*p(?![a-z])", "salt and pepper", text)
    return " ".join(text.split())


def is_header(text: str) -> bool:
    """Whether a clean line names a section or nothing: it ends in a colon, or has no letter or digit."""
    return text.endswith(":") or not any(c.isalnum() for c in text)


def _unit(word: str) -> str | None:
    word = word.rstrip(".")
    return _CASED.get(word) or _SPELLED.get(word.lower())


def _tokens(text: str) -> list[tuple[str, object, str, int]]:
    """(class, value, spelling, where it ends) of each token; a unit glued to a number or written in two words is one token of its own."""
    out: list[tuple[str, object, str, int]] = []
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "frac":
            a, b = (int(x) for x in word.split("/"))
            out.append(("number", a / b, word, m.end()) if b else ("word", word, word, m.end()))
        elif kind == "num":
            out.append(("number", float(word), word, m.end()))
        elif kind != "word":
            out.append((kind, word, word, m.end()))
        else:
            low = word.lower()
            two = f"{out[-1][2].lower().rstrip('.')}_{low.rstrip('.')}" if out else ""
            if two in _SPELLED:
                out[-1] = ("unit", _SPELLED[two], f"{out[-1][2]} {word}", m.end())
            elif unit := _unit(word):
                out.append(("unit", unit, word, m.end()))
            elif low in _NUMBERS:
                out.append(("number", _NUMBERS[low], word, m.end()))
            elif low == "dozen":
                out.append(("dozen", 12.0, word, m.end()))
            elif low in ("x", "×"):
                out.append(("times", word, word, m.end()))
            elif low in ("of", "each", *_NEAR):
                out.append(("near" if low in _NEAR else low, word, word, m.end()))
            else:
                out.append(("size" if low in _SIZES else "word", word, word, m.end()))
    return out


#: (state, class) -> (step, next state); what is not here ends the amount.
_TABLE = {
    ("start", "near"): ("skip", "start"), ("start", "number"): ("amount", "amount"), ("start", "dozen"): ("dozen", "amount"), ("start", "size"): ("size", "start"), ("start", "unit"): ("one", "unit"),
    ("amount", "number"): ("second", "amount"), ("amount", "dozen"): ("dozen", "amount"), ("amount", "range"): ("skip", "range"), ("amount", "times"): ("skip", "times"), ("amount", "size"): ("size", "amount"), ("amount", "unit"): ("unit", "unit"),
    ("amount", "near"): ("skip", "amount"), ("amount", "each"): ("skip", "amount"), ("amount", "plus"): ("skip", "more"), ("amount", "of"): ("skip", "end"),
    ("range", "number"): ("top", "topped"), ("range", "range"): ("skip", "range"), ("topped", "unit"): ("unit", "unit"), ("topped", "number"): ("second", "amount"), ("topped", "size"): ("size", "amount"), ("topped", "range"): ("skip", "glued"), ("topped", "dozen"): ("dozen", "amount"),
    ("amount", "glued"): ("skip", "glued"), ("glued", "unit"): ("pack", "packed"),
    ("times", "number"): ("pack_amount", "pack"), ("pack", "range"): ("skip", "pack_range"), ("pack_range", "range"): ("skip", "pack_range"), ("pack_range", "number"): ("pack_top", "pack"), ("pack_range", "unit"): ("pack_unit", "packed"), ("pack", "unit"): ("pack_unit", "packed"),
    ("packed", "unit"): ("unit", "unit"), ("packed", "size"): ("size", "packed"), ("packed", "range"): ("skip", "packed"),
    ("unit", "of"): ("skip", "unit"), ("unit", "near"): ("skip", "unit"), ("unit", "plus"): ("skip", "more"), ("unit", "number"): ("again", "unit"),
    ("more", "number"): ("extra", "added"), ("added", "number"): ("extra_more", "added"), ("added", "unit"): ("add", "unit"),
}


class _Reader:
    """Registers that the table's steps fill; a step that cannot be taken returns False and ends the amount."""

    def __init__(self, tokens):
        self.tokens = tokens
        self.out = dict.fromkeys(FIELDS)
        self.extra = 0.0
        self.i = 0

    def front(self) -> int:
        """Reads the amount; returns the number of the first token of the name."""
        state, good, out = "start", 0, dict(self.out)
        while self.i < len(self.tokens):
            kind, value, word, _ = self.tokens[self.i]
            step = _TABLE.get((state, kind))
            if step is None or getattr(self, f"_{step[0]}")(value, word) is False:
                break
            state = step[1]
            self.i += 1
            if state in ("amount", "topped", "unit", "packed", "end"):
                good, out = self.i, dict(self.out)
            if state == "end":
                break
        self.out = out  # what a half-read range or sum has left is undone
        return good

    def _ahead(self, n: int = 1) -> str | None:
        return self.tokens[self.i + n][0] if self.i + n < len(self.tokens) else None

    def _skip(self, value, word):
        pass

    def _amount(self, value, word):
        unit = self.tokens[self.i + 1] if self._ahead() == "unit" else None
        if word.isdigit() and len(word) == 2 and unit and unit[2].rstrip(".") in _SINGULAR and len(unit[2].rstrip(".")) > 3 and "/" not in word and self._lost(word) is not None:
            value = self._lost(word)  # "14 teaspoon": the slash is lost
        self.out["qty"] = value

    @staticmethod
    def _lost(word: str) -> float | None:
        a, b = int(word[0]), int(word[1])
        return a / b if len(word) == 2 and 0 < a < b and b in (2, 3, 4, 8) else None

    def _second(self, value, word):
        """A number after a number: a fraction, a fraction that lost its slash, or the size of what is counted."""
        if self.tokens[self.i - 1][0] != "number":
            return False
        if value < 1:
            self.out["qty"] += value
        elif word.isdigit() and len(word) == 2 and self._lost(word) is not None and self._ahead() == "unit":
            self.out["qty"] += self._lost(word)
        else:
            self.out |= {"pack_qty": value}
            ahead = [self._ahead(n) for n in (1, 2, 3, 4, 5)]
            if ahead[0] == "unit" or ahead[0] == "range":
                return self._sized()
            return False
        return None

    def _sized(self):
        """`5- to 6-ounce`: reads a size up to its unit."""
        j = self.i + 1
        while j < len(self.tokens) and self.tokens[j][0] in ("range", "number"):
            if self.tokens[j][0] == "number":
                self.out["pack_max"] = self.tokens[j][1]
            j += 1
        if j < len(self.tokens) and self.tokens[j][0] == "unit":
            self.out["pack_unit"] = self.tokens[j][1]
            self.i = j
            return None
        self.out |= {"pack_qty": None, "pack_max": None}
        return False

    def _dozen(self, value, word):
        self.out["qty"] = value * (self.out["qty"] or 1.0)
        if self.out["qty_max"] is not None:
            self.out["qty_max"] *= value

    def _size(self, value, word):
        self.out["size"] = word.lower()

    def _one(self, value, word):
        if "i" not in _CLASS[value] or self._ahead() is None or self.out["size"] and self._ahead() not in ("of", "word"):
            return False
        self.out |= {"qty": 1.0, "unit": value}
        return None

    def _top(self, value, word):
        if value <= self.out["qty"]:
            return False
        self.out["qty_max"] = value
        return None

    def _unit(self, value, word):
        if self._ahead() is None and not (self.tokens[self.i - 1][0] == "number" and value in _FACTORS):
            return False  # "3 cloves" names cloves
        self.out["unit"] = value
        return None

    def _pack_amount(self, value, word):
        self.out["pack_qty"] = value

    def _pack_top(self, value, word):
        self.out["pack_max"] = value

    def _pack_unit(self, value, word):
        self.out["pack_unit"] = value

    def _pack(self, value, word):
        self.out |= {"pack_qty": self.out["qty"], "pack_max": self.out["qty_max"], "pack_unit": value, "qty": 1.0, "qty_max": None}

    def _again(self, value, word):
        """`1 clove 1 clove`: the same amount once more says nothing new."""
        same = value == self.out["qty"] and self._ahead() == "unit" and self.tokens[self.i + 1][1] == self.out["unit"]
        if not same:
            return False
        self.i += 1
        return None

    def _extra(self, value, word):
        self.extra = value

    def _extra_more(self, value, word):
        if value >= 1:
            return False
        self.extra += value
        return None

    def _add(self, value, word):
        first = self.out["unit"]
        if first is None or (ratio := _ratio(value, first)) is None:
            return False
        self.out["qty"] += self.extra * ratio
        if self.out["qty_max"] is not None:
            self.out["qty_max"] += self.extra * ratio
        return None


def _ratio(unit: str, to: str) -> float | None:
    """How many of `to` one `unit` is; none across dimensions."""
    if unit == to:
        return 1.0
    a, b = _FACTORS.get(unit), _FACTORS.get(to)
    return a[1] / b[1] if a and b and a[0] == b[0] else None


def _brackets(text: str) -> tuple[str, list[str]]:
    """A line without its brackets, and what stood in them; an open one ends with the line."""
    notes: list[str] = []

    def take(m):
        notes.append(m[1].strip(" ,;"))
        return " "

    while True:
        less = re.sub(r"[(\[]([^()\[\]]*)(?:[)\]]|\Z)", take, text)
        if less == text:
            return " ".join(re.sub(r"[)\]]", " ", text).split()), [n for n in notes if n]
        text = less


def _size_of(note: str) -> tuple[float, float | None, str] | None:
    """(qty, max, unit) of a note that is nothing but an amount, such as a package's size."""
    tokens = [t for t in _tokens(note) if t[0] not in ("near", "each", "range")]
    if len(tokens) in (2, 3) and all(t[0] == "number" for t in tokens[:-1]) and tokens[-1][0] == "unit":
        first, last = tokens[0][1], tokens[-2][1]
        if len(tokens) == 3 and last < 1:
            return first + last, None, tokens[-1][1]
        return first, last if len(tokens) == 3 else None, tokens[-1][1]
    return None


def _is_prep(text: str) -> bool:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return any(w in _PREPARED or w.endswith("ed") and len(w) > 4 for w in words)


def _describes(text: str) -> bool:
    """Whether a text is adjectives only, so that the comma after it parts no name from its preparation."""
    words = [w for w in text.lower().split() if w not in _SIZES]
    return bool(words) and all(w.endswith("less") or w in ("fresh", "ripe", "dry", "dried", "lean", "raw", "whole") for w in words)


def _named(out: dict, rest: str, notes: list[str]) -> dict:
    """Name, preparation and notes of what follows an amount."""
    tail = re.search(r"(?i)(?:^|\s)(?:plus|\+)\s+(?=[\d.]|(?:" + "|".join(_NUMBERS) + r")\b)", rest)
    if tail:  # "... sugar plus 2 tablespoons": more of the same, or a note
        more = _Reader(_tokens(rest[tail.end() :]))
        used = more.front()
        end = tail.end() + (more.tokens[used - 1][3] if used else 0)
        ratio = _ratio(more.out["unit"], out["unit"]) if more.out["unit"] and out["unit"] else None
        if tail.start() == 0 and used:
            notes, rest = [*notes, rest[:end].strip()], rest[end:].lstrip(" .")
        elif more.out["qty"] is not None and ratio is not None and used == len(more.tokens):
            out["qty"] += more.out["qty"] * ratio
            rest = rest[: tail.start()]
        else:
            notes, rest = [*notes, rest[tail.start() :].strip()], rest[: tail.start()]
    parts = [p.strip() for p in re.split(r"[,;]", rest)]
    while len(parts) > 1 and _describes(parts[0]):
        parts[:2] = [f"{parts[0]}, {parts[1]}"]
    name, preps = parts[0], []
    for part in parts[1:]:
        if fruit := re.fullmatch(rf"(?i)({'|'.join(_FRUIT)}) of", part):
            name = f"{name} {fruit[1].lower()}"
        elif part:
            (preps if _is_prep(part) else notes).append(part)
    name = re.sub(r"(?i)^of\s+|\s*\b(?:to|for) (?:taste|garnish|serving)\b|\s*\bas needed\b|\s*\boptional\b", "", name).strip(" .-")
    first, either, second = name.partition(" or ")
    if either:  # of alternatives the first is the name; "red or green apples" share the head
        shared = second.split()[1:] if len(first.split()) == 1 else []
        name, notes = " ".join([first, *shared]), [*notes, f"or {second}"]
    if out["unit"] is None and out["qty"] is not None:
        words = name.split()
        for i in range(1, len(words)):
            unit = _unit(words[i])
            if unit and "p" in _CLASS[unit] and len(words[i]) > 2 and not _describes(" ".join(words[:i])):  # "6 garlic cloves skin removed"
                out["unit"] = unit
                preps[:0] = [" ".join(words[i + 1 :])] if words[i + 1 :] else []
                name = " ".join(words[:i])
                break
    return out | {"name": name or None, "prep": ", ".join(preps) or None, "note": "; ".join(notes) or None}


_CJK_UNIT = "|".join(sorted((w for w in _SPELLED if not w[0].isascii()), key=len, reverse=True))
_CJK = re.compile(rf"^(?P<name>[^\d\s][^\d]*?)\s*(?:(?P<qty>\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\s*(?:-\s*(?P<top>\d+(?:\.\d+)?))?\s*(?P<unit>{_CJK_UNIT}|[a-zA-Z]+)?|(?P<taste>适量|少许))$")


def parse(line: str | None) -> dict:
    """One line's parts; a line without amount is all name, a header, an empty line and a line of signs have none."""
    none = dict.fromkeys(FIELDS)
    text = clean(line)
    if not text or is_header(text):
        return none
    taste, optional = bool(_TASTE.search(text)), bool(_OPTIONAL.search(text))
    if re.search(r"[぀-ヿ一-鿿]", text) and (m := _CJK.match(text)):
        a, _, b = (m["qty"] or "").partition("/")
        qty = float(a) / (float(b) if b and float(b) else 1.0) if a else None
        return none | {"qty": qty, "qty_max": float(m["top"]) if m["top"] else None, "unit": _unit(m["unit"]) if m["unit"] else None, "name": m["name"].strip(), "optional": optional or taste and qty is None}
    bare, notes = _brackets(text)
    fruit = re.match(rf"(?i)^({'|'.join(_FRUIT)}) of (?=(?:\d|{'|'.join(_NUMBERS)}\b))", bare)
    if fruit:  # "juice of 1 lime": so many limes, of which the juice
        bare = bare[fruit.end() :]
    reader = _Reader(_tokens(bare))
    used = reader.front()
    out = reader.out
    at = reader.tokens[used - 1][3] if used else 0
    if out["pack_qty"] is None and out["qty"] is not None:
        for note in notes:
            if (size := _size_of(note)) and not re.match(r"(?i)about|approx|around|roughly|or\b", note) and (out["unit"] is None or "c" in _CLASS[out["unit"]]):
                out |= dict(zip(("pack_qty", "pack_max", "pack_unit"), size, strict=True))
                notes = [n for n in notes if n != note]
                break
    rest = bare[at:].lstrip(" -.") if used else bare
    out = _named(out, rest, [n for n in notes if not re.fullmatch(r"(?i)optional", n)])
    if out["name"] is None and out["unit"] and out["unit"] not in _FACTORS:
        out |= {"name": out["unit"], "unit": None}  # "1 clove 1 clove": the unit is what is meant
    if fruit and out["name"]:
        out["name"] = f"{out['name']} {fruit[1].lower()}"
    return out | {"optional": optional or taste and out["qty"] is None}


def split_items(line: str | None, known: frozenset[str]) -> list[str]:
    """The items of a line such as `salt, pepper and oil`, if every one of them is known; else the line as it is."""
    parts = [p.strip() for p in re.split(r",\s*(?:and\s+)?|\s+and\s+|\s*&\s*", line or "") if p.strip()]
    return parts if len(parts) > 1 and all(p.lower() in known for p in parts) else [line] if line else []


def _parsed(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in lines], columns=list(FIELDS)).astype({c: object for c in FIELDS})


def parse_line(line: Column) -> Column:
    return F.pandas_udf(_parsed, SCHEMA)(line)


def parse_lines(rows: DataFrame, line: str) -> DataFrame:
    """The rows with the parts of their line; each distinct line is parsed once. A null line has no parts."""
    parts = rows.select(F.col(line).alias("_line")).where("_line is not null").distinct().select("_line", parse_line(F.col("_line")).alias("_parts"))
    return rows.join(parts, rows[line] == parts["_line"], "left").select(*(rows[c] for c in rows.columns), "_parts.*")
