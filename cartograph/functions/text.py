"""String rules as Column expressions (SCL-1, SCL-3, SCL-4, FTS tokens).

Built from ``pyspark.sql.functions``, so it stays inside whole-stage code
generation; only the stemmer of :func:`lexemes` is an Arrow function
(:mod:`.porter2`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartograph.functions.porter2 import porter2, stems

# English stop words removed before matching (the common
# English stop list used by full-text engines).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# Token separator: any run of characters that are not letters or digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(name) -> Column:
    """SCL-1: lower, non ``[a-z0-9]`` runs to ``-``, strip one ``-`` at each end;
    empty result becomes ``product``."""
    s = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("product")).otherwise(s)


def slug_family(slug) -> Column:
    """A slug without any trailing ``-digits`` groups (SCL-2 partition key)."""
    return F.regexp_replace(_col(slug), "(-[0-9]+)+$", "")


# White space and control characters, which the rules trim and count as blank.
BLANK = r"^[\x00-\x20]*$"


def trim(c) -> Column:
    """Text without white space and control characters at either end."""
    return F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c) -> Column:
    """Null, empty, or only white space and control characters."""
    return _col(c).isNull() | _col(c).rlike(BLANK)


def normalise_email(c) -> Column:
    """SCL-4: trim, then lower-case."""
    return F.lower(trim(c))


def first_name(full, email) -> Column:
    """SCL-3: text before the first space of the trimmed name; when blank,
    the part of the e-mail before ``@``."""
    parts = F.split(trim(full), " ", 2)
    first = F.get(parts, 0)
    fallback = F.substring_index(_col(email), "@", 1)
    return F.when(is_blank(full) | (first == ""), fallback) \
        .otherwise(F.coalesce(first, fallback))


def last_name(full) -> Column:
    """SCL-3: text after the first space of the trimmed name, else ``''``."""
    parts = F.split(trim(full), " ", 2)
    return F.coalesce(F.get(parts, 1), F.lit(""))


def like_pattern_contains(q: str) -> str:
    """``%q%`` as a LIKE pattern in which ``%`` and ``_`` of ``q`` stay
    wildcards (as in the reference) and a backslash is taken literally
    (a lone backslash would make Spark's LIKE raise)."""
    return "%" + q.replace("\\", "\\\\") + "%"


def tokens(text) -> Column:
    """Lower-cased letter/digit tokens of ``text`` (null text: empty)."""
    arr = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), TOKEN_SPLIT)
    return F.filter(arr, lambda t: t != "")


def lexemes(text) -> Column:
    """FTS-1 document vector as an array: tokens, stop words removed, stemmed
    (:mod:`.porter2`), de-duplicated (PostgreSQL ``to_tsvector`` keeps
    positions; matching with ``@@`` only needs presence)."""
    # array_except is hash based (one probe per token), de-duplicates, and also
    # drops the empty tokens a leading separator leaves, so "" joins the stop list
    stop = F.array(*[F.lit(s) for s in STOP_WORDS + [""]])
    raw = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), TOKEN_SPLIT)
    return F.array_distinct(stems(F.array_except(raw, stop)))


def lexemes_of(text: str | None) -> list[str]:
    """:func:`lexemes` of one given text (a search's own words)."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return list(dict.fromkeys(porter2(w) for w in words if w not in STOP_WORDS))
