"""Text expressions: cleaning, keyword rules, tokens.

All are plain ``Column -> Column`` built-ins, so they fuse into the scan stage,
need no shuffle and work on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V

# Java's \w and \s are ASCII; these classes follow Unicode letters/digits and
# the 29 Unicode space characters.
WORD = r"[\p{L}\p{N}_]"
_SPACE = r"\t-\r\x1c-\x1f \x85\p{Z}"
SPACE = f"[{_SPACE}]"
NON_SPACE = f"[^{_SPACE}]"
# the same characters one by one, for trimming
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    Spark copies an expression to each place that names it; a lambda variable is
    bound to its result instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (a plain ``trim`` knows blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def _any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def clean_text(text: Column) -> Column:
    """Drop URLs, mask mentions, unwrap hashtags, collapse white space."""
    no_urls = F.regexp_replace(text, rf"http{NON_SPACE}+|www\.{NON_SPACE}+", "")
    masked = F.regexp_replace(no_urls, f"@{WORD}+", "@user")
    unwrapped = F.regexp_replace(masked, f"#({WORD}+)", "$1")
    # a plain sub-string search is far cheaper than three patterns without a match
    marked = _any_of([text.contains(mark) for mark in ("@", "#", "http", "www.")])
    plain = F.when(marked, unwrapped).otherwise(text)
    # after the collapse a blank is the only space left, so trim is enough
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def length_ok(text: Column, low: int = V.MIN_CHARS, high: int = V.MAX_CHARS) -> Column:
    """True when the text has ``low`` to ``high`` code points, both included."""
    return F.length(text).between(low, high)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when the lower-cased text contains one of the sub-strings."""
    lowered = F.lower(text)
    return _any_of([lowered.contains(word) for word in words])


def where_length_ok(rows: DataFrame, name: str, text: Column, **bounds: int) -> DataFrame:
    """``rows`` with column ``name`` = ``text``, only where the length is allowed.

    A filter on a computed column makes Spark compute it in the filter and again
    in the projection.  As a generator of one or no row it is computed once.
    """
    kept = F.filter(F.array(text), lambda t: length_ok(t, **bounds))
    return rows.select(*[c for c in rows.columns if c != name], F.explode(kept).alias(name))


def irony_rule(text: Column) -> Column:
    """A praising word together with a negative context."""
    return contains_any(text, V.IRONY_WORDS) & contains_any(text, V.NEGATIVE_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank; empty below two words."""
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    leading = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(leading, following, lambda a, b: F.concat_ws(" ", a, b))


def ngrams(words: Column, n: int = 2) -> Column:
    """Words, and for ``n=2`` the bigrams after them."""
    if n not in (1, 2):
        raise ValueError("only uni- and bigrams are supported")
    return words if n == 1 else let(words, lambda w: F.concat(w, bigrams(w)))
