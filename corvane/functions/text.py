"""Column functions on text: normal forms, tokens, shingles, hashes and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.lines import BULLET, CODE, ENUMERATED

TOKEN = "[a-z0-9]+(?:_[a-z0-9]+)*"
WORD = "[A-Za-z]+(?:-[A-Za-z]+)*"

# Glyphs that office exports leave behind, and what they stand for.
GLYPHS_TO_TEXT = {"c\u20dd": "\u00a9", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff"}
GLYPHS_ONE_TO_ONE = {
    "\u00a0": " ", "\uf0b7": "\u2022", "\uf0a7": "\u25aa", "\uf0d8": "\u27a2", "\uf076": "\u2756", "\uf0fc": "\u2713",
    "\uf0e0": "\u2192", "\uf0e8": "\u2794", "\uf06e": "\u25a0", "\uf071": "\u2751", "\uf0a8": "\u25a1",
}
GLYPHS_DROPPED = "\u00ad\u200b\ufeff\u20dd"


def repair_glyphs(text: Column) -> Column:
    """Ligatures, private-use bullets, no-break spaces and invisible characters; longer glyphs first."""
    for glyph, plain in GLYPHS_TO_TEXT.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    return F.translate(text, "".join(GLYPHS_ONE_TO_ONE) + GLYPHS_DROPPED, "".join(GLYPHS_ONE_TO_ONE.values()))


def code_like(text: Column) -> Column:
    """Whether a line looks like one of a C-like language: a sign of code, and none of prose, a bullet or a numbered item.

    Prose has over 14 words without ; or {, or six words or more that end with a full stop.
    """
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.size(F.split(bare, r"\s+"))
    sentence = F.endswith(bare, F.lit(".")) & (words >= 6)
    wordy = (words > 14) & ~F.contains(bare, F.lit(";")) & ~F.contains(bare, F.lit("{"))
    item = bare.rlike(BULLET.pattern) | bare.rlike("(?i)" + ENUMERATED.pattern)
    return F.coalesce(bare.rlike("(?i)" + CODE.pattern) & ~sentence & ~wordy & ~item, F.lit(False))


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def plain_form(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space: the form in which texts count as identical."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(plain_form(text), 256)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: Spark repeats an expression wherever a branch or a lambda names it."""
    return F.transform(F.array(value), use)[0]


def _grams(words: Column, k: int) -> Column:
    """The runs of k words as structs w0, w1, ...; fewer words are one, with nulls at its end."""
    # shifted copies side by side: a lambda over positions would look the words up anew for each of them
    zipped = F.arrays_zip(*[F.slice(words, F.lit(i + 1), F.size(words)).alias(f"w{i}") for i in range(k)])
    return F.slice(zipped, F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles of the plain form; a shorter text is one shingle, an empty one has none."""

    def own(plain: Column) -> Column:
        grams = bound(F.split(plain, " "), lambda words: F.transform(_grams(words, k), lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(k)])))
        return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return bound(plain_form(text), own)


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """XXH64 of each distinct shingle's words, in order; an empty text is one shingle of an empty word."""
    hashes = bound(F.split(plain_form(text), " "), lambda words: F.transform(_grams(words, k), lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(k)])))
    return F.sort_array(F.array_distinct(hashes))


def document_id(path: Column) -> Column:
    """Slug of the file's stem, 40 characters at most, and 8 hex digits of the path's SHA-1."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    strip = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    slug = strip(F.substring(strip(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-")), 1, 40))
    return F.concat(slug, F.lit("-"), F.substring(F.sha1(path), 1, 8))


def topic_area(path: Column) -> Column:
    """The first folder of a relative path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("unknown")


def point_id(key: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """UUID version 5 (SHA-1) of a name in the URL namespace, from bits of the digest."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\n\r]+"))).cast("long")
