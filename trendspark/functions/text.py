"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import LANGUAGE_GROUPS

# The characters taken off both ends of a text (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Character classes. Upper case is the letter class plus the circled, squared and
# roman capitals; digits are the decimal class plus the superscript, subscript and enclosed ones.
UPPER_CLASS = (
    r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}"
    r"\x{1F170}-\x{1F189}]"
)
LOW_DIGIT_CLASS = r"[0-9\x{B2}\x{B3}\x{B9}]"
HIGH_DIGIT_CLASS = (
    r"[\p{Nd}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
    r"\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}"
    r"\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}"
    r"\x{1F100}-\x{1F10A}]"
)
# Beyond the Latin letters; texts without such a character need no look at the other scripts.
BEYOND_LATIN = r"[^\x{00}-\x{36F}]"
SCRIPT_CLASSES = {
    "has_cyrillic": r"[\x{0400}-\x{04FF}]",
    "has_cjk": r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]",
    "has_arabic": r"[\x{0600}-\x{06FF}]",
    "has_devanagari": r"[\x{0900}-\x{097F}]",
}

# Scripts that settle the language, most specific first.
SCRIPT_LANGUAGES = (
    ("ja", r"[\x{3040}-\x{30FF}]"),
    ("ko", r"[\x{AC00}-\x{D7A3}]"),
    ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("uk", r"[іїєґ]"),
    ("ru", r"[\x{0400}-\x{04FF}]"),
    ("fa", r"[پچژگ]"),
    ("ar", r"[\x{0600}-\x{06FF}]"),
    ("hi", r"[\x{0900}-\x{097F}]"),
    ("bn", r"[\x{0980}-\x{09FF}]"),
    ("ta", r"[\x{0B80}-\x{0BFF}]"),
    ("te", r"[\x{0C00}-\x{0C7F}]"),
    ("ml", r"[\x{0D00}-\x{0D7F}]"),
)

# Frequent short words by language; ties go to the language named first.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "is", "was", "that", "for", "with", "by", "on", "are"),
    "fr": ("le", "les", "des", "est", "et", "une", "dans", "que", "qui", "pour", "elle", "un", "la"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "ein", "zu", "auf", "den", "im"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "para", "del", "una", "es", "la"),
    "it": ("il", "di", "che", "per", "non", "con", "gli", "della", "sono", "una", "lo", "nel", "la"),
    "pt": ("o", "os", "que", "não", "com", "uma", "para", "dos", "em", "mais", "as", "foi", "do"),
    "nl": ("het", "een", "van", "en", "niet", "met", "voor", "zijn", "op", "dat", "aan", "ook", "de"),
}

# The instruction text every training example starts with.
PROMPT = (
    "### Instruction\n"
    "Write a viral YouTube title and a 300‑character description.\n\n"
    "### Input\n{\n  \"topic\": \"PLACEHOLDER\"\n}\n\n"
    "### Response\nTitle:"
)


def strip(text: Column) -> Column:
    """Take white space off both ends.

    The right end is looked at first, as trimming it walks the whole text.
    """
    ends_blank = F.instr(F.lit(WHITESPACE), F.right(text, F.lit(1))) > 0
    return F.ltrim(F.when(ends_blank, F.rtrim(text, F.lit(WHITESPACE))).otherwise(text), F.lit(WHITESPACE))


def truncate_text(text: Column, limit: int, keep: int | None = None) -> Column:
    """Texts longer than ``limit`` are cut to ``keep`` characters (default ``limit``) plus "..."."""
    cut = limit if keep is None else keep
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)


def digit_count(text: Column) -> Column:
    """Number of digit characters, the superscript and enclosed ones included."""
    low = F.regexp_count(text, F.lit(LOW_DIGIT_CLASS))
    high = F.regexp_count(F.regexp_replace(text, r"[\x{00}-\x{36F}]+", ""), F.lit(HIGH_DIGIT_CLASS))
    return low + F.when(F.rlike(text, F.lit(BEYOND_LATIN)), high).otherwise(F.lit(0))


def text_features(text: Column) -> dict[str, Column]:
    """Nine features of a text: size, marks, ratios and script flags."""
    size = F.length(text)
    at_least_one = F.greatest(size, F.lit(1)).cast("double")
    found = {
        "length": size,
        "question_marks": size - F.length(F.replace(text, F.lit("?"), F.lit(""))),
        "exclamation_marks": size - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "uppercase_ratio": F.regexp_count(text, F.lit(UPPER_CLASS)).cast("double") / at_least_one,
        "digit_ratio": digit_count(text).cast("double") / at_least_one,
    }
    for name, pattern in SCRIPT_CLASSES.items():
        found[name] = F.rlike(text, F.lit(pattern)).cast("int")
    return found


def detect_language(text: Column) -> Column:
    """Language code of a text from its script and, for Latin script, its frequent words.

    Missing texts, texts of fewer than 5 characters without the outer white space, and texts that
    match no profile are "en". Each text is judged within its own row, so nothing is shuffled.
    """
    by_script = F.lit(None).cast("string")
    for code, pattern in reversed(SCRIPT_LANGUAGES):
        by_script = F.when(F.rlike(text, F.lit(pattern)), F.lit(code)).otherwise(by_script)
    by_script = F.when(F.rlike(text, F.lit(BEYOND_LATIN)), by_script)

    every = sorted({w for known in STOP_WORDS.values() for w in known})
    hits = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*every))

    def best(found: Column) -> Column:
        def count(known: tuple[str, ...]) -> Column:
            return F.size(F.filter(found, lambda w: w.isin(*known)))

        scores = [
            F.struct(count(known).alias("hits"), F.lit(-place).alias("place"), F.lit(code).alias("code"))
            for place, (code, known) in enumerate(STOP_WORDS.items())
        ]
        return F.array_max(F.array(*scores))["code"]

    # The array of one holds the hits, so that they are found once and not once per language.
    by_words = F.get(F.transform(F.array(hits), best), F.lit(0))
    blank = text.isNull() | (F.length(strip(text)) < 5)
    return F.when(blank, F.lit("en")).otherwise(F.coalesce(by_script, by_words))


def language_group(code: Column) -> Column:
    """Group of a language code, "other" where none is listed."""
    group = F.lit("other")
    for name, codes in LANGUAGE_GROUPS.items():
        group = F.when(code.isin(*codes), F.lit(name)).otherwise(group)
    return group


def prefix_group(text: Column, code: Column) -> Column:
    """``[group] text``."""
    return F.concat(F.lit("["), language_group(code), F.lit("] "), text)


def short_description(description: Column, size: int = 300) -> Column:
    """The stripped description up to ``size`` characters; missing is empty."""
    return F.substring(strip(F.coalesce(description, F.lit(""))), 1, size)


def response_text(title: Column, description: Column) -> Column:
    """Title, and below it the short description where there is one."""
    short = short_description(description)
    # One reference to the text, so that Spark does not strip it twice.
    tail = F.regexp_replace(short, r"\A(?s)(?=.)", "\nDescription: ")
    return F.concat(F.coalesce(title, F.lit("")), tail)


def text_key(text: Column) -> Column:
    """Lookup key of a text: line breaks become blanks, outer white space goes."""
    return strip(F.translate(text, "\n", " "))
