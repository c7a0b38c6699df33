"""Text cleaning as regular expressions and array functions.

Classes are spelled out so that Java matches what a Unicode-aware engine would:
``\\p{L}\\p{N}_`` for word characters, White_Space plus the four ASCII separators for space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

# Stop words used when no list is given.
STOP_WORDS = ("the", "and", "is", "in", "to", "of")

# What the two cleaners look for.
LINKS_AND_MENTIONS = rf"(?U)http{NON_SPACE}+|www{NON_SPACE}+|@{WORD}+"
NOT_LETTERS_DIGITS = r"(?U)[^a-z0-9\s\x1c-\x1f]"
NOT_LETTERS = r"(?U)[^a-z\s\x1c-\x1f]"
MEDIA_HOSTS = ("preview.redd.it", "i.redd.it", "v.redd.it", "redditstatic.com")
MEDIA_FILES = r"(?:png|jpe?g|webp|gif|mp4)"
MEDIA_PARAMS = (
    "w", "width", "h", "height", "format", "auto", "fit", "crop", "quality", "q", "s", "amp",
    "fps", "duration", "loop", "mute", "controls",
)
HANDLES = rf"(?<!{WORD})u/[A-Za-z0-9_-]+|@[A-Za-z0-9_]+"
URLS = rf"(?U)https?://{NON_SPACE}+|www\.{NON_SPACE}+"
BLOCK_QUOTES = rf"(?U)(^|\n){SPACE}{{0,3}}>{SPACE}[^\n]*"
SPACES = rf"(?U){SPACE}+"
HANDLE_MASK, URL_MASK = "@user", "http"

# A file name can only begin where a run of non-space characters begins, or right behind the
# previous match; saying so keeps the scan linear in the length of a run.
_HOSTS = "|".join(host.replace(".", r"\.") for host in MEDIA_HOSTS)
MEDIA_URLS = (
    rf"(?iuU)(?:https?://)?(?:{_HOSTS})"
    rf"|(?:(?<!{NON_SPACE})|\G){NON_SPACE}+\.{MEDIA_FILES}(?:\?{NON_SPACE}+)?"
)
MEDIA_QUERY = rf"(?iuU)(?<!{WORD})(?:{'|'.join(MEDIA_PARAMS)})={NON_SPACE}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: Column | str) -> Column:
    """Words of a text; a blank text has none."""
    return F.filter(F.split(_col(text), SPACES), lambda w: w != "")


def without_words(tokens: Column | str, words: Iterable[str]) -> Column:
    """Tokens not in ``words``; duplicates and order stay (``array_except`` would lose both)."""
    listed = sorted(set(words))
    return F.filter(_col(tokens), lambda w: ~w.isin(listed)) if listed else _col(tokens)


def strip_links(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), LINKS_AND_MENTIONS, "")


def clean_tokens(
    text: Column | str,
    keep_numbers: bool = True,
    remove_urls: bool = True,
    stop_words: Iterable[str] = STOP_WORDS,
    lemma: Callable[[Column], Column] | None = None,
) -> Column:
    """Lower case, drop links and mentions, keep letters (and digits), drop stop words, lemmatise."""
    out = F.lower(F.coalesce(_col(text), F.lit("")))
    if remove_urls:
        out = strip_links(out)
    out = F.regexp_replace(out, NOT_LETTERS_DIGITS if keep_numbers else NOT_LETTERS, "")
    tokens = without_words(split_words(out), stop_words)
    return F.transform(tokens, lemma) if lemma else tokens


def clean_text(text: Column | str, **options) -> Column:
    return F.array_join(clean_tokens(text, **options), " ")


def strip_media_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), MEDIA_URLS, " ")


def strip_media_params(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), MEDIA_QUERY, " ")


def mask_handles(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), HANDLES, HANDLE_MASK)


def mask_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), URLS, URL_MASK)


def drop_quotes(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), BLOCK_QUOTES, "")


def unescape_ampersand(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("&amp;"), F.lit("&"))


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), SPACES, " "))


def preprocess(text: Column | str, remove_preview: bool = True) -> Column:
    """Normalise a post for model scoring; case and punctuation stay."""
    out = F.coalesce(_col(text), F.lit(""))
    if remove_preview:
        out = strip_media_params(strip_media_urls(out))
    for step in (mask_handles, mask_urls, drop_quotes, unescape_ampersand, collapse_spaces):
        out = step(out)
    return out


def full_text(title: Column | str = "title", body: Column | str = "body") -> Column:
    """Title over body; null if either is."""
    return F.concat(_col(title), F.lit(":\n"), _col(body))
