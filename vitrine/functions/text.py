"""Text clean-up and classification as Column expressions (JVM side)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- Fixed values -------------------------------------------------------------------------------
# Whitespace as a browser regular expression sees it (wider than Java's \s).
WHITESPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Control, zero-width and bidirectional characters that are dropped from messages.
INVISIBLE = (
    r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f"
    r"\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
)
HEBREW_POINTS = r"[\u0591-\u05c7]"
HEBREW_BLOCK = r"[\u0590-\u05ff]"
ID_PATTERN = r"^[A-Za-z0-9._:-]+$"
MESSAGE_CHARS = 1000
QUERY_CHARS = 200
# Phrases of an attempt to override a chat assistant's instructions, English then Hebrew.
OVERRIDE_PATTERNS = [
    r"ignore\s+(all\s+|the\s+)?(previous|prior|above|earlier)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above|earlier)",
    r"(system|initial|original)\s+(prompt|instructions|message)",
    r"(reveal|repeat|print|output|show)\s+(me\s+)?(your|the)\s+(prompt|instructions|rules|system)",
    r"you\s+are\s+now|pretend\s+to\s+be|act\s+as\s+(a|an|if)|roleplay\s+as",
    r"developer\s+mode|jailbreak|\bDAN\b",
    r"התעלם\s+מ(כל\s+)?(ההוראות|ההנחיות|הכללים)",
    r"(הוראות|הנחיות)\s+ה?מערכת",
    r"(תגלה|תחשוף|תדפיס|תחזור\s+על)\s+.{0,20}(ההוראות|ההנחיות|הפרומפט)",
    r"שכח\s+(את\s+)?(ההוראות|ההנחיות|מה\s+שאמרו)",
    r"מעכשיו\s+אתה|תתנהג\s+כאילו",
]
_NOT_UNDERSTOOD = "לא הצלחתי להבין את ההודעה. אפשר לכתוב במילים מה אתה מחפש?"
JUNK_REPLIES = {
    "empty": "לא קיבלתי שאלה. מה אתה מחפש?",
    "no_letters": _NOT_UNDERSTOOD,
    "symbol_soup": _NOT_UNDERSTOOD,
    "repeated_char": _NOT_UNDERSTOOD,
    "repeated_word": _NOT_UNDERSTOOD,
    "long_token": "ההודעה נראית כמו טקסט שהודבק בטעות. אפשר לכתוב בקצרה מה אתה מחפש?",
}
TRIGGER_REASONS = ["no_results", "out_of_stock", "non_literal"]
OPENERS = {
    "no_results": "לא מצאתי מוצר שתואם בדיוק למה שחיפשת — אבל בוא נראה יחד מה כן מתאים.",
    "out_of_stock": "מה שחיפשת אזל כרגע מהמלאי. יש כמה דברים דומים שאפשר להשיג — רוצה שאראה לך?",
    "non_literal": "החיפוש שלך לא ממש נפתר בשורת חיפוש. ספר לי מה אתה מחפש ואעזור לצמצם.",
}
SITUATIONS = {
    "no_results": "הלקוח חיפש באתר %s ולא הוחזרו לו תוצאות.",
    "out_of_stock": "הלקוח חיפש באתר %s וכל מה שהתאים אזל מהמלאי.",
    "non_literal": "הלקוח חיפש באתר %s — שאילתה לא מילולית שהתוצאות שלה לא בהכרח עונות עליה.",
    "other": "הלקוח חיפש באתר %s.",
}
UNNAMED_QUERY = "משהו"
# Phrases that make a short query a complex one, and price-range shapes.
COMPLEX_PHRASES = ["suitable for", "recommended", "around", "מתאים", "מומלץ", "באיזור"]
CONTEXT_WORDS = ["for", "with", "under", "between", "לארוחת", "עם", "בשביל"]
PRICE_RANGE = r"[0-9]+\s*(?:-|to)\s*[0-9]+"
# -------------------------------------------------------------------------------------------------


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``then``."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL where the key is missing."""
    chain = None
    for name, value in values.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit every limit here is stated in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_left(text: Column, units: int) -> Column:
    """First UTF-16 units; whole code points are enough unless the text leaves the basic plane.

    A surrogate pair the limit would split is left out, as a string cannot hold half of it.
    """

    def cut(t: Column) -> Column:
        raw = F.encode(t, "UTF-16BE")
        splits = F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB")
        whole = F.when(splits, 2 * units - 2).otherwise(2 * units)
        binary = F.decode(F.substring(raw, F.lit(1), whole), "UTF-16BE")
        return (
            F.when(F.length(t) * 2 <= units, t)
            .when(utf16_length(t) > F.length(t), binary)
            .otherwise(F.substring(t, 1, units))
        )

    return let(text, cut)


def sanitize(text: Column, max_chars: int = MESSAGE_CHARS) -> Column:
    """Drop invisible characters, escape angle brackets, collapse spaces, cut."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    clean = F.replace(F.replace(clean, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return utf16_left(collapse_spaces(clean), max_chars)


def has_content(text: Column) -> Column:
    """Whether anything is left after sanitising, from the first character that stays."""
    return text.rlike(f"[^{WHITESPACE[1:-1]}{INVISIBLE[1:-1]}]")


def sanitize_id(raw: Column, max_chars: int = 64) -> Column:
    clean = F.substring(js_trim(raw), 1, max_chars)
    return F.when(clean.rlike(ID_PATTERN), clean)


def junk_class(text: Column) -> Column:
    """First junk class that applies to an already sanitised message, else NULL."""

    def classify(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
        words = F.filter(F.split(t, " "), lambda w: w != "")
        return (
            F.when(F.coalesce(t, F.lit("")) == "", "empty")
            .when(letters == 0, "no_letters")
            .when(letters / utf16_length(t) < 0.35, "symbol_soup")
            .when(t.rlike(r"(.)\1{9}"), "repeated_char")
            .when(
                (F.size(words) > 3) & (F.size(F.array_distinct(F.transform(words, F.lower))) == 1),
                "repeated_word",
            )
            .when(t.rlike(r"[^ ]{61}"), "long_token")
        )

    return let(text, classify)


def override_attempt(text: Column) -> Column:
    return text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in OVERRIDE_PATTERNS) + ")")


def strip_and_clip(text: Column, max_chars: int) -> Column:
    """Tags to spaces, spaces collapsed, empty to NULL, cut with an ellipsis."""
    clean = F.nullif(collapse_spaces(F.regexp_replace(text, "<[^>]*>", " ")), F.lit(""))
    return let(
        clean,
        lambda c: F.when(utf16_length(c) > max_chars, F.concat(utf16_left(c, max_chars), F.lit("…"))).otherwise(c),
    )


def index_tokens(text: Column) -> Column:
    """Lower-cased word tokens of the text index."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(words, "")


def literal_words(text: Column) -> Column:
    """Words for the literal-hit test: points stripped, at least two characters."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), HEBREW_POINTS, "")
    return F.filter(F.split(flat, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def as_list(value: Column) -> Column:
    """A comma-separated string as a list: parts trimmed, empty ones dropped."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), js_trim)
    return F.filter(parts, lambda v: v != "")


def has_hebrew(text: Column) -> Column:
    return text.rlike(HEBREW_BLOCK)


def is_simple_query(query: Column) -> Column:
    """One to three words, no indicator phrase, no price range, no contextual preposition."""
    low = collapse_spaces(F.lower(query))
    words = F.filter(F.split(low, " "), lambda w: w != "")
    phrases = "|".join(COMPLEX_PHRASES)
    return (
        F.size(words).between(1, 3)
        & ~low.rlike(phrases)
        & ~low.rlike(PRICE_RANGE)
        & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONTEXT_WORDS]))
    )


def _first_number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def price_filters(query: Column) -> Column:
    """Struct(price, price_min, price_max) read from price phrases in the query."""
    both_low = _first_number(query, r"([0-9]+)\s*(?:-|to)\s*[0-9]+")
    both_high = _first_number(query, r"[0-9]+\s*(?:-|to)\s*([0-9]+)")
    exact = F.coalesce(
        _first_number(query, r"באיזור\s+ה-?\s*([0-9]+)"),
        _first_number(query, r"(?:^|\s)ב-\s*([0-9]+)"),
    )
    low = F.coalesce(
        both_low,
        _first_number(query, r"החל\s+מ-?\s*([0-9]+)"),
        _first_number(query, r"(?:^|\s)מ-\s*([0-9]+)"),
    )
    high = F.coalesce(both_high, _first_number(query, r"עד\s+([0-9]+)"))
    return F.struct(exact.alias("price"), low.alias("price_min"), high.alias("price_max"))


def clean_query(query: Column, stop_words: Column) -> Column:
    """The query without filter words, one space between the rest."""
    words = F.filter(F.split(collapse_spaces(F.lower(query)), " "), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stop_words, w)), " ")


def opening_text(reason: Column, query: Column) -> Column:
    quoted = F.when(F.coalesce(query, F.lit("")) == "", F.lit(UNNAMED_QUERY)).otherwise(
        F.concat(F.lit('"'), query, F.lit('"'))
    )
    other = F.format_string(SITUATIONS["other"], quoted)
    chain = F.when(reason == TRIGGER_REASONS[0], F.format_string(SITUATIONS[TRIGGER_REASONS[0]], quoted))
    for name in TRIGGER_REASONS[1:]:
        chain = chain.when(reason == name, F.format_string(SITUATIONS[name], quoted))
    return chain.otherwise(other)


def normalize_nfkc(text: Column) -> Column:
    """NFKC has no Spark built-in: a Python UDF that is given no plain ASCII.

    Not an Arrow one, whose batch of 10,000 whole texts grows with their length; this one holds 100 texts at a time.
    """
    @F.udf("string", useArrow=False)
    def nfkc(value: str | None) -> str | None:
        return None if value is None else unicodedata.normalize("NFKC", value)

    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))
