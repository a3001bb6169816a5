"""Text cleaning and token rules as JVM-side column expressions.

Every function takes and returns a Column, so Catalyst can push, prune and fuse it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space, as a regex class.
WS = "[\\s\\x0B\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

# Typographic quotes and dashes and what they fold to.
FOLD_FROM = "“”‘’–—"
FOLD_TO = "\"\"''--"

# The Unicode spaces folded to a plain space in filings.
UNICODE_SPACES = "[\\u00a0\\u1680\\u2000-\\u200b\\u202f\\u205f\\u3000]"

# A line holding only a page number.
PAGE_LINE = r"(?dm)^[ \t]*(?:-\s*\d{1,3}\s*-|\d{1,3}|Page\s+\d{1,3}(?:\s+of\s+\d{1,3})?)[ \t]*\n"

# A section number split from its title by line breaks.
SPLIT_HEADING = r"(?dm)^([ \t]*(?:(?:Section|SECTION)[ \t]+)?\d{1,2}\.\d{1,2}\.?)[ \t]*\n+[ \t]*([A-Z])"

# Running lines are stripped lines of this length, repeated this often, not headings.
RUNNING_MIN_CHARS, RUNNING_MAX_CHARS, RUNNING_MIN_COUNT = 4, 79, 8
HEADING_LINE = r"(?i)^(?:section|article)\b|^\(?[a-z0-9]{1,4}\)"

# What an agreement calls itself, and how side documents start.
MERGER_TITLES = (
    "agreement and plan of merger",
    "plan and agreement of merger",
    "agreement of merger",
    "plan of merger",
    "merger agreement",
)
SIDE_TITLES = ("termination", "voting", "support", "tender", "letter")
TITLE_SCAN, TITLE_LINE_MAX, TITLE_FALLBACK = 3000, 160, 200

# Words dropped from a company name.
COMPANY_SUFFIX = (
    r"\b(?:incorporated|inc|corporation|corp|company|co|ltd|limited|llc|plc|nv|holdings|holding|group|the)\b"
)

# The 0x80-0x9F bytes of windows-1252 (undefined ones become U+FFFD).
CP1252_HIGH = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def canonical(c: Column) -> Column:
    """The text all offsets refer to: no byte-order mark, line feeds only."""
    return F.regexp_replace(F.regexp_replace(c, "^\\uFEFF", ""), "\\r\\n?", "\n")


def decode_bytes(content: Column) -> Column:
    """UTF-8 with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def decode_filing(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else windows-1252 (Latin-1 plus its own 0x80-0x9F block)."""
    as_text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    high = "".join(chr(x) for x in range(0x80, 0xA0))
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.translate(latin, high, CP1252_HIGH))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normal_form(c: Column) -> Column:
    """Word-for-word form: folded quotes and dashes, single spaces."""
    return collapse_spaces(fold_quotes(c))


def squash(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", "")


def strip_page_lines(c: Column) -> Column:
    """Spaces collapsed per line, page-number lines dropped, at most one blank line in a row."""
    spaces = F.regexp_replace(c, "[ \\t\\u00A0]+", " ")
    lines = F.regexp_replace(spaces, "(?dm)^ | $", "")
    body = F.regexp_replace(F.concat(lines, F.lit("\n")), PAGE_LINE, "")
    tidy = F.regexp_replace(body, "\\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(tidy, "^\\n+|\\n+$", ""), F.lit("\n"))


def rejoin_headings(c: Column) -> Column:
    """Unicode spaces folded and a section number put back on its title's line."""
    return F.regexp_replace(F.regexp_replace(c, UNICODE_SPACES, " "), SPLIT_HEADING, "$1 $2")


def own_title(c: Column) -> Column:
    lines = F.split(F.substring(c, 1, TITLE_SCAN), "\n")
    named = F.filter(lines, lambda l: (F.length(l) < TITLE_LINE_MAX) & l.rlike(r"\b(?:AGREEMENT|PLAN)\b"))
    first = F.coalesce(F.get(named, F.lit(0)), F.substring(c, 1, TITLE_FALLBACK))
    return F.lower(collapse_spaces(first))


def is_merger_agreement(c: Column) -> Column:
    title = F.regexp_replace(own_title(c), r"^exhibit\s+[\d.]+\s*", "")
    names_it = F.exists(F.array(*[F.lit(t) for t in MERGER_TITLES]), lambda t: F.contains(title, t))
    side = F.exists(F.array(*[F.lit(t) for t in SIDE_TITLES]), lambda t: F.startswith(title, t))
    return names_it & ~side


def query_tokens(c: Column) -> Column:
    """Lower-case ASCII letter-digit runs of two or more characters, each once, in order."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_distinct(runs), lambda t: F.length(t) > 1)


def _accent_tables() -> tuple[str, str]:
    """Latin letters with a diacritic and their base letter, built from the Unicode decompositions."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isalpha():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_tables()


def index_tokens(c: Column) -> Column:
    """Index-side tokens: lower-case Unicode letter-digit runs without diacritics, repeats kept."""
    plain = F.translate(F.lower(c), ACCENT_FROM, ACCENT_TO)
    return F.regexp_extract_all(plain, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def name_words(c: Column) -> Column:
    """Words of a question or name as (raw, token): letter-digit runs, and `&` read as `and`."""
    raw = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|&"), F.lit(0))
    return F.transform(
        raw, lambda w: F.struct(w.alias("raw"), F.when(w == "&", "and").otherwise(F.lower(w)).alias("token"))
    )


def name_tokens(c: Column) -> Column:
    return F.transform(name_words(c), lambda w: w["token"])


def company_norm(c: Column) -> Column:
    s = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, COMPANY_SUFFIX, " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """`phrase` occurs in lower-case `text` with no letter or digit touching either end."""
    quoted = F.concat(
        F.lit("(?<![a-z0-9])\\Q"), F.replace(F.lower(phrase), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![a-z0-9])")
    )
    return F.rlike(text, quoted)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def split_of(c: Column) -> Column:
    """`tune` for three tenths of ids by the first byte of their sha1, else `report`."""
    first_byte = F.conv(F.substring(F.sha1(c.cast("string")), 1, 2), 16, 10).cast("int")
    return F.when(first_byte % 10 < 3, "tune").otherwise("report")


def seeded_key(c: Column, seed: int) -> Column:
    """A reproducible random order: sha1 of seed and id."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), c.cast("string")))
