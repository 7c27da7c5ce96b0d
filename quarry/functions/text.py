"""Column expressions over text (all JVM-side, inside whole-stage codegen).

Tokenisation is the one analyser of the engine: lower case, split on every run
of characters that are neither letters nor digits, drop empty pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay as stated for results to agree):
# token separator: any run of characters that are not letters or digits
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
# shortened presentation length in characters
SHORT_TEXT_CHARS = 1000
# first link in the text: http or https, then characters of the class
# "!", "$" through "_", and "a" through "z"
URL_PATTERN = r"https?://[!$-_a-z]+"
# sentence boundary for snippets: end marks followed by blanks, or a line break
SENTENCE_BOUNDARY = r"[.!?]+\s+|\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """ARRAY<STRING> of lower-cased tokens, empties removed."""
    return F.filter(F.split(F.lower(_col(text)), TOKEN_SEPARATOR), lambda t: t != "")


def shorten(text, shortened: bool = True, max_chars: int = SHORT_TEXT_CHARS) -> Column:
    """First ``max_chars`` characters when ``shortened``, else the whole text."""
    t = _col(text)
    return F.substring(t, 1, max_chars) if shortened else t


def first_url(text) -> Column:
    """First link in the text, or '' when there is none."""
    return F.regexp_extract(_col(text), URL_PATTERN, 0)


def linkify(text, url) -> Column:
    """Replace every occurrence of ``url`` by an anchor named "Source".

    With no link the text stays unchanged (replacing the empty string would
    insert a link between all characters).
    """
    t, u = _col(text), _col(url)
    link = F.concat(F.lit('<a href="'), u, F.lit('">Source</a> '))
    return F.when(u != "", F.replace(t, u, link)).otherwise(t)


def md5_hash32(token) -> Column:
    """Unsigned 32-bit hash of a string: the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(_col(token)), 1, 8), 16, 10).cast("bigint")


def sentences(text) -> Column:
    """ARRAY<STRING> of sentences (boundary pattern above), blanks trimmed."""
    parts = F.split(_col(text), SENTENCE_BOUNDARY)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
