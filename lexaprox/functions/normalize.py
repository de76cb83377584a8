"""Folding of case and diacritics, character by character, without a locale.

Diacritics first: letters of Latin-1 and Latin Extended-A become their base
letters, combining marks U+0300-U+036F go, Latin ligatures U+FB00-FB06 are spelt
out. Then case: A-Z, the same Latin letters and a few others; Greek, Cyrillic
and the rest stay. The Column form is `translate` and `replace`, so it runs in
the JVM; the Python form also tells where each character came from."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = [chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7)]
#: Letters without a decomposition to ASCII, or with one that is not wanted.
_BASE = dict(zip("æÆœŒßøØđĐħĦłŁŧŦðÐþÞıŀĿĸŋŊŉ", "ae AE oe OE ss o O d D h H l L t T d D th TH i l L q n N 'n".split()))
_LIGATURES = dict(zip(map(chr, range(0xFB00, 0xFB07)), "ff fi fl ffi ffl st st".split()))
_COMBINING = range(0x300, 0x370)


@cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """What diacritic folding and case folding make of a character."""
    base = {c: _BASE.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in _BLOCK}
    base = {c: b for c, b in base.items() if b.isascii() and b != c} | _LIGATURES | {chr(c): "" for c in _COMBINING}
    case = {chr(c): chr(c + 32) for c in range(65, 91)} | {c: c.casefold() for c in _BLOCK if c.casefold() != c} | {"µ": "μ"} | _LIGATURES
    return base, case


@cache
def _char(c: str, fold_case: bool, fold_diacritics: bool) -> str:
    base, case = _tables()
    if fold_diacritics:
        c = base.get(c, c)
    return "".join(case.get(x, x) for x in c) if fold_case else c


def normalize_text(text: str, fold_case: bool = True, fold_diacritics: bool = True) -> str:
    return "".join(_char(c, fold_case, fold_diacritics) for c in text)


@cache
def _steps(fold_case: bool, fold_diacritics: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Of both foldings together: characters for translate, what they become, and
    the others, which become several."""
    base, case = _tables()
    whole = {c: _char(c, fold_case, fold_diacritics) for c in sorted({*base, *case})}
    one = {c: b for c, b in whole.items() if len(b) == 1 and b != c}
    none = [c for c, b in whole.items() if not b]
    return "".join([*one, *none]), "".join(one.values()), tuple((c, b) for c, b in whole.items() if len(b) > 1)


def normalize(text: Column, fold_case: bool = True, fold_diacritics: bool = True) -> Column:
    """The normalised form, by built-in functions. What several letters come from
    is rare, so those are replaced only in texts that are not ASCII."""
    source, target, several = _steps(fold_case, fold_diacritics)
    if not source:
        return text
    out = text
    for c, b in several:
        out = F.replace(out, F.lit(c), F.lit(b))
    return F.when(F.length(text) == F.octet_length(text), F.translate(text, source, target)).otherwise(F.translate(out, source, target))


def sql_normalize(text: str, fold_case: bool = True, fold_diacritics: bool = True) -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    source, target, several = _steps(fold_case, fold_diacritics)
    for c, b in several:
        text = f"replace({text}, {q(c)}, {q(b)})"
    return f"translate({text}, {q(source)}, {q(target)})"


class SourceMap:
    """A normalised text, and the place in the source of each of its characters."""

    def __init__(self, source: str, fold_case: bool = True, fold_diacritics: bool = True):
        parts = [_char(c, fold_case, fold_diacritics) for c in source]
        self.text, self.source_len = "".join(parts), len(source)
        self.places = [k for k, p in enumerate(parts) for _ in p]

    def __len__(self) -> int:
        return len(self.places)

    def is_empty(self) -> bool:
        return not self.places

    def source_of(self, place: int) -> int | None:
        return self.places[place] if 0 <= place < len(self.places) else None

    def to_source(self, start: int, end: int) -> tuple[int, int] | None:
        """The smallest range of the source with all of these characters, and what
        follows them there without a character of its own."""
        n = len(self.places)
        if start > end or end > n or start < 0:
            return None
        if start == end:
            at = self.places[start] if start < n else self.source_len
            return at, at
        last = self.places[end - 1]
        owners, stop = set(self.places), last + 1
        while stop < self.source_len and stop not in owners:
            stop += 1
        return self.places[start], stop


def utf8_offset(text: Column, place: Column) -> Column:
    """Bytes before a code point's place; null beyond the end."""
    return F.when((place >= 0) & (place <= F.length(text)), F.octet_length(F.substr(text, F.lit(1), place.cast("int"))))


def utf16_offset(text: Column, place: Column) -> Column:
    """UTF-16 units before a code point's place; null beyond the end."""
    head = F.substr(text, F.lit(1), place.cast("int"))
    return F.when((place >= 0) & (place <= F.length(text)), place.cast("int") + F.regexp_count(head, F.lit("[\\x{10000}-\\x{10FFFF}]")))


def decode_symbols(raw: bytes, most: int | None = None) -> tuple[list[int], int]:
    """Code points of UTF-8 bytes, 0x110000 + b for each byte b that is none, of
    which most + 1 are kept; and how many there are."""
    out = [ord(c) if not 0xDC80 <= ord(c) <= 0xDCFF else 0x110000 + ord(c) - 0xDC00 for c in raw.decode("utf-8", "surrogateescape")]
    return out if most is None else out[: most + 1], len(out)
