"""Text columns: HTML to plain text, accent folding, slugs, word sets. All JVM-side."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions.vocabulary import CITY_WORDS, ENTITIES

_NOT_ASCII = r"[^\x00-\x7F]"
# Blank characters outside ASCII that count as white space in feed text.
_WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII character, and combining
    marks (which `translate` deletes because they have no partner)."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        if len(parts) == 1 and ord(parts[0]) < 0x80 and parts[0] != chr(code):
            source.append(chr(code))
            target.append(parts[0])
    source += [chr(code) for code in range(0x300, 0x370)]
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()
# Compatibility characters that decompose into several ASCII letters or digits.
_FOLD_MANY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "™": "TM", "℠": "SM", "№": "No", "…": "..."}


def constant(value: object, ddl: str) -> Column:
    """A nested constant as one literal; the optimizer folds it before the job runs."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


# Typography that has no decomposition, and what is printed for it.
TYPOGRAPHY = {
    "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "•": "-", "·": "-", "→": "->", "₹": "Rs ", "\u00ad": "",
}


def _printed_table() -> tuple[str, str, dict[str, str]]:
    """Characters that print as one ASCII character, those characters, and the characters that print as several."""
    source, target, many = [], [], {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        shown = "".join(c for c in "".join(TYPOGRAPHY.get(c, c) for c in parts) if " " <= c <= "~")
        if len(shown) == 1:
            source.append(chr(code))
            target.append(shown)
        elif shown:
            many[chr(code)] = shown
    return "".join(source), "".join(target), many


_PRINT_FROM, _PRINT_TO, _PRINT_MANY = _printed_table()


def _one_of(chars: list[str]) -> str:
    """A pattern of one of these characters outside ASCII, as ranges.

    A class is tried item by item, so a list of all of them would cost its length for every plain character too.
    """
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return r"(?=[^\x00-\x7F])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


_PRINT_SPECIAL = _one_of(list(_PRINT_MANY))


def printable(column: Column) -> Column:
    """A line as plain printable ASCII: typography replaced, accents off, tabs as blanks, all else dropped."""
    plain = F.translate(column, "\t" + _PRINT_FROM, " " + _PRINT_TO)

    def spelled(text: Column) -> Column:
        # Only the special characters that occur are looked up: a look-up in a map literal walks the whole map.
        special = F.array_distinct(F.regexp_extract_all(text, F.lit(_PRINT_SPECIAL), F.lit(0)))
        several = constant(_PRINT_MANY, "map<string,string>")
        whole = F.aggregate(special, text, lambda line, c: F.replace(line, c, several[c]))
        return F.regexp_replace(whole, r"[^\x20-\x7E]", "")

    return bind(plain, spelled)


def sql_text(value: str) -> str:
    """A string literal of a SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(column: Column, use: Callable[[Column], Column]) -> Column:
    """`use(column)` with the column worked out once however often `use` mentions it."""
    return F.element_at(F.transform(F.array(column), use), 1)


def plain_spaces(column: Column) -> Column:
    """Wide blanks to plain ones, so `\\s` sees them. A text of as many bytes as characters has none."""
    return bind(column, lambda text: F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _WIDE_SPACES, " " * len(_WIDE_SPACES))))


def squeeze(column: Column) -> Column:
    return F.regexp_replace(plain_spaces(column), r"\s+", " ")


def fold_accents(column: Column) -> Column:
    def fold(text: Column) -> Column:
        folded = text
        for char, plain in _FOLD_MANY.items():
            folded = F.replace(folded, F.lit(char), F.lit(plain))
        return F.when(text.rlike(_NOT_ASCII), F.translate(folded, _FOLD_FROM, _FOLD_TO)).otherwise(text)

    return bind(column, fold)


def normalize_text(column: Column) -> Column:
    """Comparison form: no accents, lower case, only letters, digits and the + # . of skill names."""
    text = F.replace(F.lower(fold_accents(column)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"[^a-z0-9+#.]+", " ")
    text = F.regexp_replace(text, r"(^|\s)\.+|\.+(?=\s|$)", "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slugify(column: Column) -> Column:
    text = F.regexp_replace(fold_accents(F.lower(column)), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(text, r"^-+|-+$", ""), 1, 80)


def stable_slug(title: Column, company: Column, source: Column, external_id: Column) -> Column:
    suffix = F.substring(F.sha1(F.concat_ws(":", source, external_id)), 1, 6)
    return F.concat(F.substring(slugify(F.concat_ws(" ", title, company)), 1, 90), F.lit("-"), suffix)


def search_text(title: Column, company: Column, location: Column, region: Column, tags: Column) -> Column:
    parts = F.concat_ws(" ", title, company, location, F.coalesce(region, F.lit("")), F.array_join(tags, " "))
    return F.trim(squeeze(F.lower(parts)))


def _code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


_AMP = "\ue000"  # stands for an ampersand that must not start another entity


def _decode_numeric(column: Column, pattern: str, base: int) -> Column:
    def substitute(text: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, pattern, 1)
        number = F.conv(F.right(digits, F.lit(9)), base, 10).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(number == 38, F.lit(_AMP)).otherwise(_code_point(F.when(valid, number).otherwise(F.lit(63))))
        return F.when(valid, F.replace(text, entity, char)).otherwise(text)

    def decode(text: Column) -> Column:
        return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, substitute)

    return bind(column, decode)


def _decode(text: Column) -> Column:
    for name, char in ENTITIES.items():
        if name != "amp":
            text = F.regexp_replace(text, f"(?i)&{name};", char)
    text = _decode_numeric(text, r"(?i)&#x([0-9a-f]+);", 16)
    text = _decode_numeric(text, r"&#(\d+);", 10)
    return F.replace(F.regexp_replace(text, r"(?i)&amp;", _AMP), F.lit(_AMP), F.lit("&"))


def decode_entities(column: Column) -> Column:
    """Named and numeric entities, decoded once: `&amp;lt;` becomes `&lt;`."""
    return bind(column, lambda text: F.when(F.contains(text, F.lit("&")), _decode(text)).otherwise(text))


def html_to_text(column: Column) -> Column:
    """Feed HTML as plain text, whole: blank-line paragraphs, `## ` headings, `- ` bullets."""
    text = F.regexp_replace(column, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(
        text, r"(?is)<h[1-6][^>]*>(?:\s|<(?!/h[1-6]>)[^>]+>)*(.*?)(?:\s|<(?!/h[1-6]>)[^>]+>)*</h[1-6]>", "\n\n## $1\n\n"
    )
    text = F.regexp_replace(text, r"(?i)<li[^>]*>", "\n- ")
    text = F.regexp_replace(text, r"(?i)</(p|div|ul|ol|section|table|tr|blockquote)>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = plain_spaces(decode_entities(text))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?m)^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    text = F.regexp_replace(text, r"(?m)^-\n", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(\n- [^\n]+)\n\n(?=- )", "$1\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_CITY_ARRAY_PATTERN = r"\b(" + "|".join(CITY_WORDS) + r")\b"


def word_set(column: Column) -> Column:
    """Distinct words without city names, so per-city copies of one text compare equal."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z0-9+#]{2,}"), F.lit(0)))
    words = F.array_except(words, constant(CITY_WORDS, "array<string>"))
    return F.filter(words, lambda w: ~(w.rlike(r"[+#]") & w.rlike(_CITY_ARRAY_PATTERN)))


def first_match(column: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first pattern the text matches."""
    pattern, value = rules[0]
    chosen = F.when(column.rlike(pattern), value)
    for pattern, value in rules[1:]:
        chosen = chosen.when(column.rlike(pattern), value)
    return chosen.otherwise(F.lit(default))
