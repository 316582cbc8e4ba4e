"""Settings and lookup tables; a TOML file may change them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

SECTIONS = ("summary", "skills", "experience", "projects", "education", "certifications", "awards", "publications", "languages", "extra_sections")

# Section -> headings that stand for it, in lower case.
HEADINGS: dict[str, list[str]] = {
    "summary": ["summary", "professional summary", "profile", "about", "about me", "objective"],
    "skills": ["skills", "technical skills", "tech stack", "technologies"],
    "experience": ["experience", "work experience", "professional experience", "employment", "employment history", "work history"],
    "projects": ["projects", "personal projects", "selected projects", "side projects"],
    "education": ["education", "academic background", "qualifications"],
    "certifications": ["certifications", "certificates", "licenses and certifications"],
    "awards": ["awards", "honors", "honours", "achievements"],
    "publications": ["publications"],
    "languages": ["languages"],
}

# Class of an HTML element -> role; `entry:<section>` wraps one entry.
HTML_ROLES: dict[str, str] = {
    "section-title": "heading", "contact-row": "contact", "separator": "skip", "competency-tag": "item",
    "job": "entry:experience", "job-company": "org", "job-period": "dates", "job-role": "title", "job-location": "location",
    "project": "entry:projects", "project-title": "title", "project-desc": "description", "project-tech": "tech",
    "edu-item": "entry:education", "edu-title": "title", "edu-org": "org", "edu-year": "dates", "edu-desc": "details",
    "cert-item": "entry:certifications", "cert-title": "title", "cert-org": "org", "cert-year": "dates",
    "award-item": "entry:awards", "award-title": "title", "award-org": "org", "award-year": "dates",
    "skill-item": "skill", "skill-category": "category",
}

# LaTeX macro -> role of each argument ("" ignores it, "body" is content).
LATEX_ROLES: dict[str, list[str]] = {
    "name": ["name", "name"], "address": ["location", "", ""], "phone": ["phone"], "email": ["email"], "extrainfo": ["links"],
    "cventry": ["dates", "title", "org", "location", "", "body"], "vspace": [""], "needspace": [""], "makecvtitle": [], "small": [],
}

# The wording of rendered sections.
STANDARD_HEADINGS = {s: s.capitalize() for s in SECTIONS[:-1]}


@dataclass(frozen=True)
class Config:
    """What a user may set; the three tables of a file add to the defaults key by key."""

    section_order: tuple[str, ...] = SECTIONS
    date_format: str = "%b %Y"
    group_roles: bool = False
    keep_heading_text: bool = False
    drop_sections: tuple[str, ...] = ("references",)
    keywords: tuple[str, ...] = ()
    heading_synonyms: dict[str, list[str]] = field(default_factory=lambda: dict(HEADINGS))
    html_classes: dict[str, str] = field(default_factory=lambda: dict(HTML_ROLES))
    latex_macros: dict[str, list[str]] = field(default_factory=lambda: dict(LATEX_ROLES))

    def __post_init__(self) -> None:
        if unknown := [s for s in self.section_order if s not in SECTIONS]:
            raise ValueError(f"unknown sections {unknown}; there are {', '.join(SECTIONS)}")

    def section_of(self) -> dict[str, str]:
        """Heading in lower case -> section; of two sections with one heading the first wins."""
        out: dict[str, str] = {}
        for section, names in self.heading_synonyms.items():
            for name in names:
                out.setdefault(name, section)
        return out


def load(text: str) -> Config:
    """Settings from TOML; unknown keys are errors."""
    given = tomllib.loads(text)
    known = {f.name for f in fields(Config)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings {sorted(unknown)}; there are {', '.join(sorted(known))}")
    base = Config()
    for table in ("heading_synonyms", "html_classes", "latex_macros"):
        if table in given:
            given[table] = getattr(base, table) | given[table]
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def keyword_lines(text: str) -> list[str]:
    """Keywords of a dictionary file: lines that are neither blank nor begin with '# '."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("# ")]
