"""Text expressions: normal form, language signals, codes, phones, URLs and lenient JSON."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def letters() -> tuple[str, str]:
    """Latin letters with marks and the plain ones that they decompose to, lower case, by the Unicode tables."""
    pairs = {"ł": "l", "đ": "d", "ø": "o"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        if len(low) == 1 and len(plain) == 1 and plain != low and plain.isascii():
            pairs[low] = plain
    return "".join(pairs), "".join(pairs.values())


#: Letters with marks and the plain ones that stand for them.
ACCENTED, PLAIN = letters()

#: Marker letters and function words that speak for a language.
MARKERS = {"en": "", "de": "äöüß", "fr": "çèêëàùœ", "es": "ñóáí"}
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "that", "is", "with", "was", "this"],
    "de": ["der", "die", "das", "und", "nicht", "von", "des", "für"],
    "fr": ["le", "les", "des", "une", "dans", "pour", "que", "en"],
    "es": ["el", "los", "del", "que", "para", "una", "las", "esta"],
}


def normal(text: Column) -> Column:
    """Lower case, no accents, runs of one punctuation mark and of white space collapsed, trimmed."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"([!?.,;:*#$%&-])\1+", "$1"), r"[ \t\n\r]{2,}|[\t\n\r]", " "))


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def language_scores(low: Column, tokens: Column) -> dict[str, Column]:
    """3 for each marker letter that occurs, 2 for each function word that is a token."""
    return {
        lang: (reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(c)), 3).otherwise(0) for c in letters], F.lit(0)) + 2 * F.size(F.array_intersect(tokens, F.array(*map(F.lit, FUNCTION_WORDS[lang]))))).cast("int")
        for lang, letters in MARKERS.items()
    }


def language(text: Column, margin: int = 2) -> Column:
    """The language ahead of all others by ``margin``; '' where none is."""

    def best(x: Column) -> Column:
        ranked = F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(lang).alias("l")) for lang, s in language_scores(x["low"], x["tokens"]).items())))
        return F.transform(F.array(ranked), lambda r: F.when((F.get(r, F.lit(0))["s"] < 0) & (F.get(r, F.lit(1))["s"] - F.get(r, F.lit(0))["s"] >= margin), F.get(r, F.lit(0))["l"]).otherwise(""))[0]

    # Bound once: lower case and tokens serve every language and letter.
    return F.transform(F.array(F.struct(F.lower(text).alias("low"), F.array_distinct(F.split(F.lower(text), r"[ \t\n\r.,;:!?|]+")).alias("tokens"))), best)[0]


def postcodes(text: Column) -> Column:
    """Distinct codes of the forms 12-345, 123 45 and 12345, without their separator, in text order."""
    found = F.regexp_extract_all(text, F.lit(r"(\b\d{2}-\d{3}\b|\b\d{3} \d{2}\b|\b\d{5}\b)"))
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, "[ -]", "")))


def first_phone(text: Column) -> Column:
    """The first run of 9 to 15 digits with single separators, digits only; null without one."""
    found = F.regexp_replace(F.regexp_extract(text, r"(\d(?:[ .()-]?\d){8,14})", 1), r"\D", "")
    return F.when(found != "", found)


def phone_normal(digits: Column) -> Column:
    """Without 00 and the country prefixes 48, 49, 420 and 421 where 9 digits or more remain."""
    plain = F.when(digits.startswith("00"), F.substring(digits, 3, 20)).otherwise(digits)
    return F.when(plain.startswith("420") & (F.length(plain) >= 12) | plain.startswith("421") & (F.length(plain) >= 12), F.substring(plain, 4, 20)).when((plain.startswith("48") | plain.startswith("49")) & (F.length(plain) >= 11), F.substring(plain, 3, 20)).otherwise(plain)


def phone_pretty(digits: Column) -> Column:
    return F.regexp_replace(digits, r"(.{3})(?=.)", "$1 ")


def url_canonical(url: Column) -> Column:
    """https, no www or m host, no query, fragment or last slash, in lower case."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", ""), r"^[a-z]+://", "")
    return F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(low, r"^(www|m)\.", ""), "/+$", ""))


def url_group_key(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://[^/]+/([^/?#]+)", 1)


def lenient_json(text: Column) -> Column:
    """From the first brace to the last; null without both."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def clamp_enum(value: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(allowed), low).otherwise(default)


#: Words that stand for no answer.
NO_ANSWER = ("", "null", "none", "brak", "nie podano", "n/a", "-")


def text_or_null(value: Column, most: int = 200) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*NO_ANSWER), None).otherwise(F.substring(F.trim(value), 1, most))


def as_bool(value: Column, default: bool = False) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("tak", "yes", "true", "1"), True).when(low.isin("nie", "no", "false", "0"), False).otherwise(default)


def confidence(value: Column) -> Column:
    # least and greatest skip nulls: what is no number has to be 0 before.
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value.cast("string").try_cast("int"), F.lit(0))))


def price(value: Column) -> Column:
    number = F.regexp_replace(F.regexp_replace(value.cast("string"), r"[^0-9,.]", ""), ",", ".").try_cast("double")
    return F.when((number > 0) & (number < 1_000_000), number)


def relative_age(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60).cast("long")
    return (
        F.when(minutes < 1, "now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))
    )


def quoted(text: Column, most: int = 200) -> Column:
    """Cut at the last blank before ``most`` characters, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def masked(text: Column) -> Column:
    """Secrets, mail addresses and phone numbers are starred."""
    out = F.regexp_replace(text, r"(?i)(password|token|secret|api_key)=[^ \n]+", "$1=***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "***@***")
    return F.regexp_replace(out, r"\+?\d(?:[ .()-]?\d){8,14}", "***")
