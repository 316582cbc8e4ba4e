"""Plain text: the first line is the name; what comes before the first heading may be contacts and a headline."""

from __future__ import annotations

import re

from tessera.config import Config
from tessera.sources.blocks import Parsed, has_contact, headline_shaped, section_for, squeezed

_BULLET = re.compile(r"[-•*·▪◦‣]\s+(.*)")
_NO_HEADING = re.compile(r"[\d@|,.]")


def is_heading(line: str, config: Config) -> bool:
    """A known heading, or up to four words in capitals without digits and the like."""
    bare = line.rstrip(":")
    return section_for(bare, config) is not None or (bare.isupper() and len(bare.split()) <= 4 and _NO_HEADING.search(bare) is None)


def parse(source: str, config: Config) -> Parsed:
    out = Parsed()
    lines = [squeezed(raw) for raw in source.splitlines()]
    full = [k for k, line in enumerate(lines) if line]
    headings = {k for k in full[1:] if is_heading(lines[k], config)}
    body = min(headings, default=len(lines))
    for k in full:
        line, last = lines[k], out.blocks[-1] if out.blocks else None
        wraps = k > 0 and lines[k - 1] and line[0].islower() and last is not None and last.kind in ("bullet", "paragraph") and last.role is None
        if k == full[0]:
            out.put("line", line, role="name")
        elif k in headings:
            out.put("heading", line.rstrip(":"), level=2)
        elif bullet := _BULLET.fullmatch(line):
            out.put("bullet", bullet[1])
        elif k < body and has_contact(line):
            out.contacts(line)
        elif k < body and out.follows_name() and headline_shaped(line):
            out.put("line", line, role="headline")
        elif wraps:
            last.text += " " + line
        else:
            out.put("paragraph", line)
    return out
