"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folded() -> tuple[dict[str, str], dict[str, str]]:
    """Small letters and signs that Unicode's compatibility decomposition turns into one ASCII sign, marks aside, and those that it turns into several."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for point in range(0x80, 0x10000):
        ch = chr(point)
        if 0xD800 <= point < 0xE000 or ch.lower() != ch:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).replace("\u2044", "/").lower()
        if plain and plain != ch and plain.isascii():
            (one if len(plain) == 1 else more)[ch] = plain
    return one, more


_ONE, SPREAD = _folded()
MARKED, PLAIN = "".join(_ONE), "".join(_ONE.values())
# Signs that a table of single letters is enough for, or that have no such decomposition: ASCII, Latin letters, common punctuation, kana, Han and Hangul; other texts are folded sign by sign.
_RARE = r"[^\x00-\x7f\x{a1}-\x{bb}\x{bf}-\x{12f}\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}-\x{2027}\x{20ac}\x{3041}-\x{30fe}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
# The small letters with marks of Latin-1, and what they become without; for the SQL that checks queries.
LATIN, LATIN_PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# Named entities: those of Latin-1, punctuation, signs and Greek, from the standard library; a hard space is a plain one.
ENTITIES = {name: chr(point) for name, point in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}


def fold(text: Column) -> Column:
    """Small letters in compatibility decomposition without combining marks, as far as that is ASCII, and without apostrophes."""
    plain = F.translate(F.lower(text), MARKED + "'’", PLAIN)  # what has no counterpart goes
    spread = F.create_map(*(F.lit(v) for pair in SPREAD.items() for v in pair))
    split = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(spread, c), c)), "")
    # Most texts are told by their length, and of others only what is not ASCII goes through the long class of signs.
    rare = (F.length(text) != F.octet_length(text)) & F.regexp_replace(text, r"[\x00-\x7f]+", "").rlike(_RARE)
    return F.when(rare, F.regexp_replace(split, r"\p{Mn}+", "")).otherwise(plain)


def normalise(text: Column) -> Column:
    """Lower case in Unicode's compatibility decomposition without marks; `&` becomes `and`, apostrophes go, other punctuation becomes a space; single spaces."""
    x = fold(text)
    return F.trim(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def singular(word: Column) -> Column:
    """A plain rule for English plurals; words of three letters and less stay."""
    return (
        F.when(F.length(word) <= 3, word).when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ch|sh|x|ss)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """(at, gram) of every n tokens in a row."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.struct((i - 1).alias("at"), F.array_join(F.slice(tokens, i, n), " ").alias("gram"))))


#: Entities that most pages keep to; texts without others are decoded by plain replacement.
_COMMON = ("lt", "gt", "quot", "nbsp", "copy", "middot", "apos")


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as their characters, each once; unknown ones stay."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        point = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 7)).cast("int")
        real = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(F.coalesce(F.try_element_at(names, ref), char), F.substr(part, F.length(ref) + 2)), F.concat(F.lit("&"), part))

    plain = text
    for name in (*_COMMON, "amp"):  # `amp` last, so that nothing is decoded twice
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    parts = F.split(text, "&")
    decoded = F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), one))
    rare = text.rlike(rf"&(?!(?:{'|'.join(_COMMON)}|amp);)")
    return F.when(~F.contains(text, F.lit("&")), text).when(~rare, plain).otherwise(F.array_join(decoded, ""))


def html_to_text(html: Column) -> Column:
    """Drops scripts, styles and comments; raw line ends become spaces, line breaks stand at `br`, `div` and `p` ends; entities are decoded."""
    x = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"[\r\n]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"<br */?>|</div>|</p>", "\n"), r"<[^>]*>", "")
    x = unescape(x)
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n ?", "\n"), F.lit(" \n"))


def host(url: Column) -> Column:
    """Lower-case host without port and without a leading `www.`, `www2.` or `m.`."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^(www2?|m)\.", "")


def iso_minutes(duration: Column) -> Column:
    """`PT1H30M` to minutes; none where that is zero."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(duration, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    total = part("H") * 60 + part("M")
    return F.when(duration.startswith("PT") & (total > 0), total)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?。])\s+|;"), lambda s: F.trim(s) != "")
