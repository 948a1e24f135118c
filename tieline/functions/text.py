"""Text normalisers as Column expressions. None of them leaves the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from tieline.functions import fixed_values as fv

ASCII_WORD = "[A-Za-z0-9_]"
_WORD_EDGE = f"(?:(?<!{ASCII_WORD})(?={ASCII_WORD})|(?<={ASCII_WORD})(?!{ASCII_WORD}))"


def ascii_words(pattern: str) -> str:
    """Java's word boundary knows Unicode letters; the rule patterns mean ASCII ones."""
    return pattern.replace(r"\b", _WORD_EDGE)


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once: a lambda argument can be named many times without
    its expression being repeated, which keeps nested normalisers small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nullif_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Drop control and zero-width characters, fold every kind of space, trim; null becomes ''.

    Both classes are cut with what is not printable ASCII, so that the common character is told by one comparison, not by one for each range."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    out = F.regexp_replace(
        out, r"[[^ -~]&&[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B-\u200D\uFEFF]]", ""
    )
    out = F.regexp_replace(
        out, r"[[^!-~]&&[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]+", " "
    )
    return F.trim(out)


def optional(c: Column) -> Column:
    """`clean`, with empty and placeholder values as null."""
    return let(clean(c), without_placeholder)


def without_placeholder(cleaned: Column) -> Column:
    return F.when((cleaned != "") & ~F.lower(cleaned).isin(fv.PLACEHOLDERS), cleaned)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, str]:
    """Compatibility folding as a rule over Unicode: for every character outside ASCII, what
    remains of its NFKD form once U+0300–036F are gone. Characters that leave exactly one ASCII
    letter or digit go to a `translate` table, dropped ones to its tail, and the rare longer ones
    (ligatures, fractions, unit signs) to a map used only by rows that hold one."""
    single_from, single_to, dropped, longer = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0x300 <= code <= 0x36F:
            dropped.append(ch)
            continue
        folded = unicodedata.normalize("NFKD", ch)
        if folded == ch:
            continue
        kept = "".join(
            x if x in "abcdefghijklmnopqrstuvwxyz0123456789" else " "
            for x in folded
            if not 0x300 <= ord(x) <= 0x36F
        )
        if not kept.strip():
            continue
        if len(kept) == 1:
            single_from.append(ch)
            single_to.append(kept)
        else:
            longer[ch] = kept
    return "".join(single_from), "".join(single_to), "".join(dropped), json.dumps(longer)


def _ranges(chars: str, gap: int = 16) -> str:
    """A character class holding `chars`, as few ranges; above U+2000 small gaps are closed, which only
    sends a few more rows down the exact path."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code - spans[-1][1] <= (gap if code > 0x2000 else 1):
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"{chr(a)}-{chr(z)}" for a, z in spans)


def comparison_key(c: Column) -> Column:
    """Lower-cased, accent-free, punctuation-free key."""
    return _key_of_clean(clean(c))


def _key_of_clean(cleaned: Column) -> Column:
    single_from, single_to, dropped, longer_json = _folding()
    longer_chars = _ranges("".join(json.loads(longer_json)))

    def expand(low: Column) -> Column:
        longer_map = F.from_json(F.lit(longer_json), "map<string,string>")
        spread = F.transform(F.split(low, ""), lambda ch: F.coalesce(F.try_element_at(longer_map, ch), ch))
        return F.when(low.rlike(f"[{longer_chars}]"), F.array_join(spread, "")).otherwise(low)

    def fold(low: Column) -> Column:
        plain = F.translate(expand(low), single_from + dropped, single_to)
        return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low)

    return F.trim(F.regexp_replace(let(F.lower(cleaned), fold), "[^a-z0-9]+", " "))


def header_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", " "))


def person_name(c: Column) -> Column:
    return F.regexp_replace(clean(c), r"\s*,\s*$", "")


def full_name(first: Column, last: Column) -> Column:
    return person_name(F.concat_ws(" ", nullif_blank(clean(first)), nullif_blank(clean(last))))


def _network_path(c: Column) -> Column:
    """Path of a URL on the network's host, else null."""

    def path_of(url: Column) -> Column:
        host = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
        path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
        return F.when(host.rlike(fv.NETWORK_HOST), path)

    with_scheme = lambda raw: F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return let(let(clean(c), with_scheme), path_of)


def profile_slug(c: Column) -> Column:
    """Handle of a profile URL, percent-decoded and lower-cased, else null."""
    # url_decode would turn a literal plus sign into a space.
    decode = lambda raw: F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    handle = let(F.regexp_extract(_network_path(c), r"(?i)/(?:in|pub)/([^/]+)", 1), decode)
    return nullif_blank(F.regexp_replace(F.lower(handle), "/+$", ""))


def profile_url(c: Column) -> Column:
    return F.concat(F.lit(fv.PROFILE_PREFIX), profile_slug(c))


def company_url(c: Column) -> Column:
    handle = F.regexp_extract(_network_path(c), r"(?i)/(?:company|school|showcase)/([^/]+)", 1)
    return F.concat(F.lit(fv.COMPANY_PREFIX), nullif_blank(F.lower(handle)))


def email(c: Column) -> Column:
    return let(F.lower(clean(c)), lambda raw: F.when(raw.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), raw))


def phone(c: Column) -> Column:
    long_enough = lambda digits: F.when(F.length(F.regexp_replace(digits, r"\+", "")) >= 6, digits)
    return let(F.regexp_replace(clean(c), r"[^0-9+]", ""), long_enough)


def company_name(c: Column) -> Column:
    """Without a trailing parenthetical; the whole text when nothing else is left."""
    shorten = lambda raw: F.coalesce(nullif_blank(F.trim(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", ""))), raw)
    return let(optional(c), shorten)


_SUFFIX_TAIL = "( (" + "|".join(fv.LEGAL_SUFFIXES) + "))+$"


def company_key(c: Column) -> Column:
    """Same key for names that differ by legal suffix; '' when there is no name. The first word
    never follows a blank, so the pattern cannot strip the whole name."""
    key = _key_of_clean(F.coalesce(company_name(c), F.lit("")))
    return F.regexp_replace(key, _SUFFIX_TAIL, "")


def title(c: Column) -> Column:
    return nullif_blank(F.trim(F.regexp_replace(optional(c), r"\s*[-–—|]\s*$", "")))


def location(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(optional(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(parts, ", ")


def school(c: Column) -> Column:
    return optional(c)


def parse_count(c: Column) -> Column:
    """First integer after dropping everything but digits and minus signs; junk and negatives are 0."""
    digits = F.regexp_extract(F.regexp_replace(clean(c), "[^0-9-]", ""), "^-?[0-9]+", 0)
    return F.greatest(F.coalesce(digits.try_cast("int"), F.lit(0)), F.lit(0))


def key_of(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def effective_key(key: Column, name: Column) -> Column:
    """Stored company key, or the folded name where none was stored."""
    return F.coalesce(nullif_blank(key), key_of(name))


def slug(c: Column) -> Column:
    underscored = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(underscored, "^_|_$", ""), 1, 80)


def csv_cell(c: Column) -> Column:
    """Guard against spreadsheet formulas, then quote; null is an empty cell."""
    quoted = F.concat(F.lit('"'), F.replace(formula_guard(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(quoted, F.lit(""))


def formula_guard(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_filename(c: Column) -> Column:
    """Basename reduced to a conservative character set, at most 200 characters."""
    base = F.element_at(F.split(F.regexp_replace(c, r"[\\/]+$", ""), r"[\\/]"), -1)
    base = F.regexp_replace(F.regexp_replace(base, r"\x00", ""), r"[^a-zA-Z0-9._ ()-]", "_")
    base = F.trim(F.regexp_replace(base, r"^\.+", ""))

    def shorten(name: Column) -> Column:
        extension = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
        short = F.concat(F.substring(name, F.lit(1), F.lit(200) - F.length(extension)), extension)
        return F.when(name == "", F.lit("unnamed")).when(F.length(name) > 200, short).otherwise(name)

    return let(base, shorten)
