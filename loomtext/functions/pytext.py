"""Text functions as native column expressions, with the semantics of Python's ``re`` and ``str`` on Unicode text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character is a letter, a number or an underscore; marks and joiners are none.
W = r"[\p{L}\p{N}_]"
#: White space of Python, for patterns with the flag (?U).
S = r"[\s\x1c-\x1f]"
#: Digits of three scripts, and the signs within a number, each with its plain form.
DIGITS = "0-9٠-٩۰-۹"
LOCAL_SIGNS, PLAIN_SIGNS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹−٬٫⁄：", "01234567890123456789-,./:"
#: What counts as a number, an address of the web, an e-mail address, a placeholder, a Latin word.
NUMBER = rf"(?<!{W})[+\-−]?[{DIGITS}](?:[{DIGITS},٬.٫/⁄:：\-]*[{DIGITS}])?(?!{W})"
URL = rf"(?U)https?://(?:(?!{S})[^<>()])+"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
PLACEHOLDER = r"ZXQPH[A-Z]+QXZ"
LATIN_WORD = rf"(?<!{W})[A-Za-z]{{4,}}(?!{W})"

RTL = ("fa", "ar")


def strip(c: Column) -> Column:
    """White space off both ends, as Python's ``strip``."""
    return F.regexp_replace(c, rf"(?U)\A{S}++|(?<!{S}){S}++\z", "")


def is_blank(c: Column) -> Column:
    """True for null, '' and white space only."""
    return F.coalesce(~c.rlike(rf"(?U)(?!{S})[\s\S]"), F.lit(True))


def every(c: Column, pattern: str) -> Column:
    """All matches, in order; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def canonical_numbers(c: Column) -> Column:
    """Standalone numbers with plain digits and signs."""
    return F.transform(every(c, NUMBER), lambda x: F.translate(x, LOCAL_SIGNS, PLAIN_SIGNS))


def urls(c: Column) -> Column:
    return every(c, URL)


def emails(c: Column) -> Column:
    """As EMAIL finds them; looked for only where a run of its letters begins or the match before ended, so in linear time."""
    return every(c, EMAIL.replace("[", r"(?:(?<![\p{L}\p{N}_.+-])|\G)[", 1).replace("]+@", "]++@", 1))


def latin_words(c: Column) -> Column:
    return every(c, LATIN_WORD)


def casefold(c: Column) -> Column:
    """Lower case with sharp s spelled out; other full foldings differ in 300 rare code points."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def token_estimate(c: Column) -> Column:
    """Tokens of a text by its length: one for 2.6 characters, and 8."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(2.6)).cast("int") + 8)


def direction(language: Column) -> Column:
    return F.when(language.isin(*RTL), "rtl").when(language == "en", "ltr")


def alpha_id(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA: any number from 0 on, in bijective base 26; null for a negative one."""
    n = n.cast("bigint")
    letters, least, power = [], 0, 1
    while least < 1 << 63:  # the letter of each place, where the number is long enough to have it
        place = F.chr(F.call_function("div", n - F.lit(least), F.lit(power)) % 26 + 65)
        letters.insert(0, F.when(n >= F.lit(least), place).otherwise(""))
        power *= 26
        least += power
    return F.when(n >= 0, F.concat(*letters))


def alnum_form(c: Column) -> Column:
    """Letters and numbers only, case folded."""
    return casefold(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def output_name(name: Column, language: Column) -> Column:
    """A safe file name with the language before its suffix."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    suffix = F.regexp_extract(base, r"[^.](\.[^.]+)\z", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(suffix))
    safe = F.regexp_replace(F.regexp_replace(stem, rf"[^\p{{L}}\p{{N}}_. -]+", "_"), r"\A[ .]+|[ .]+\z", "")
    return F.concat(F.when(safe == "", "translation").otherwise(safe), F.lit("."), language, suffix)


def unit_html(text: Column, size: Column, color: Column, font: Column, language: Column, fallback: str = "Noto Sans", spaced: bool = True) -> Column:
    """A unit as an HTML block in its style."""
    rtl = direction(language) == "rtl"
    escaped = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    own = F.regexp_replace(F.coalesce(font, F.lit("")), r"\A[A-Z]{6}\+", "")
    family = F.replace(F.when(rtl | (own == ""), fallback).otherwise(own), F.lit("'"), F.lit(""))
    points = F.greatest(F.lit(7.0), F.coalesce(size, F.lit(11.0))).cast("string")
    rgb = F.lower(F.lpad(F.hex(F.coalesce(color, F.lit(0)).bitwiseAND(0xFFFFFF)), 6, "0"))
    style = F.concat(
        F.lit("font-family:'"), family, F.lit("',sans-serif;font-size:"), points, F.lit("pt;color:#"), rgb, F.lit(";direction:"), F.when(rtl, "rtl").otherwise("ltr"),
        F.lit(";text-align:"), F.when(rtl, "right").otherwise("left"), F.lit(";line-height:1.3;margin:"), F.lit("0 0 .7em 0" if spaced else "0"),
    )
    return F.concat(F.lit('<div style="'), style, F.lit('">'), escaped, F.lit("</div>"))
