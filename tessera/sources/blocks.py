"""What every parser makes: blocks in order, and links."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from tessera.config import Config

_EDGE = re.compile(r"\s+[|•·]\s+")
_ADDRESS = re.compile(r"(https?://)?[\w-]+(\.[\w-]+)+(/\S*)?")
#: The longest line under a name that is a headline.
HEADLINE = 80


@dataclass
class Block:
    kind: str
    text: str
    level: int = 0
    role: str | None = None
    url: str | None = None
    new_entry: bool = False
    section: str | None = None


@dataclass
class Parsed:
    """A parsed source: add blocks with `put`, which squeezes white space and leaves out empty ones."""

    blocks: list[Block] = field(default_factory=list)
    links: list[dict[str, str]] = field(default_factory=list)

    def put(self, kind: str, text, **more) -> Block | None:
        text = squeezed(text)
        if not text:
            return None
        self.blocks.append(Block(kind, text, **more))
        return self.blocks[-1]

    def link(self, text: str, url: str) -> None:
        self.links.append({"text": text, "url": url})

    def follows_name(self) -> bool:
        return bool(self.blocks) and self.blocks[-1].role == "name"

    def contacts(self, line: str) -> None:
        """A block for each part of 'mail | phone | site'; a bare web address gets a URL."""
        for part in filter(None, map(str.strip, _EDGE.split(line))):
            url = None
            if "@" not in part and _ADDRESS.fullmatch(part):
                url = part if part.startswith("http") else "https://" + part
                self.link(part, url)
            self.blocks.append(Block("line", part, role="contact", url=url))

    def rows(self) -> list[dict]:
        return [asdict(b) for b in self.blocks]


@dataclass(frozen=True)
class Frame:
    """What running text is until the next frame. `linked`: its first link is the block's url; `apart`: each link is a block; `first`: the first block with that mark starts an entry."""

    kind: str = "paragraph"
    role: str | None = None
    level: int = 0
    url: str | None = None
    linked: bool = False
    apart: bool = False
    first: Any = None


def assembled(marks: Iterable[tuple[str, Any]], out: Parsed) -> Parsed:
    """Blocks and links from a flat stream of marks, which parsers of trees make.

    ("text", words); ("open", None), then ("bold", None), ("link", url), ("target", url), which counts without words too, or ("plain", None) for what lies between; ("frame", Frame) ends a block and begins another;
    ("entry", section), whose blocks but headings belong to that section and the first of them to a new entry, until ("entry", None).
    """
    frame, open_, links, started = Frame(), [[]], len(out.links), set()
    section, entry = None, 0
    for mark, value in [*marks, ("frame", None)]:
        if mark == "text":
            open_[-1].append(value)
        elif mark == "open":
            open_.append([])
        elif mark in ("bold", "link", "target", "plain"):
            words = "".join(open_.pop())
            if mark == "target" or (mark == "link" and words.strip()):
                out.link(squeezed(words), value)
            open_[-1].append(f"**{words.strip()}**" if mark == "bold" and words.strip() and "**" not in words else words)
        else:
            words, found = "".join(open_[0]), out.links[links:]
            for text, url in [(x["text"], x["url"]) for x in found] if frame.apart else [(words, found[0]["url"] if frame.linked and found else frame.url)]:
                block = out.put(frame.kind, text, role=frame.role, level=frame.level, url=url)
                label = frame.first if section is None or frame.kind == "heading" else entry
                if block and label is not None:
                    block.new_entry = label not in started
                    started.add(label)
                    block.section = section if label is entry else None
            open_, links = [[]], len(out.links)
            if mark == "entry":
                section, entry = value, object()
            else:
                frame = value
    return out


def squeezed(text) -> str:
    return " ".join(str(text or "").split())


def has_contact(line: str) -> bool:
    return "@" in line or _EDGE.search(line) is not None


def headline_shaped(line: str) -> bool:
    return len(line) <= HEADLINE and not line.endswith(".")


def section_for(heading: str, config: Config) -> str | None:
    return config.section_of().get(squeezed(heading.replace("**", "")).lower())
