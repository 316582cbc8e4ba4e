"""The same dates for single strings, with their places: what parsers and folds need inside Python."""

from __future__ import annotations

import re

from tessera.functions.dates import ISO, MONTHS, NAMED, NUMERIC, OPEN, RANGE, YEAR

_RANGE = re.compile(RANGE, re.I)
_ISO = re.compile(ISO)
_PARTS = re.compile(rf"(?:(?P<name>{NAMED})|(?P<number>{NUMERIC}))?(?P<year>{YEAR})", re.I)


def iso(token: str) -> str:
    token = token.strip()
    if _ISO.fullmatch(token):
        return token[:7]
    if not (m := _PARTS.fullmatch(token)):
        return "present"
    month = MONTHS.index(m["name"][:3].lower()) + 1 if m["name"] else int(m["number"][:-1]) if m["number"] else 0
    return f"{m['year']}-{month:02d}" if month else m["year"]


def ranges(text: str) -> list[tuple[str, str | None, int, int]]:
    """(start, end, from, to) of every date or range; a lone open word is none."""
    return [(iso(m[1]), iso(m[2]) if m[2] else None, *m.span()) for m in _RANGE.finditer(text) if m[2] or m[1].lower() not in OPEN]


def whole_range(text: str) -> tuple[str, str | None] | None:
    """The one date or range that the text is."""
    found = ranges(text)
    return found[0][:2] if len(found) == 1 and found[0][2:] == (0, len(text)) else None
