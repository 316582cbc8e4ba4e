"""Records as word-processor files: a zip of XML with built-in styles, right tab stops and real links, and no tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.plans.render import contacts, sections

# The parts of the package that are always the same, and paper sizes in twentieths of a point.
PAPER = {"a4": (11906, 16838), "us-letter": (12240, 15840)}
MARGIN = 1080
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for n, k in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + "</Types>"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ROOT = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="word/document.xml"/></Relationships>'
_STYLES = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles {_W}>' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{d}><w:name w:val="{n}"/>{p}</w:style>' for i, n, d, p in (("Normal", "Normal", ' w:default="1"', ""), ("Title", "Title", "", '<w:rPr><w:b/><w:sz w:val="36"/></w:rPr>'), ("Heading1", "heading 1", "", '<w:pPr><w:keepNext/><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:b/><w:sz w:val="26"/></w:rPr>'), ("ListBullet", "List Bullet", "", '<w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr>'))) + "</w:styles>"
_NUMBERING = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:numbering {_W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:pPr><w:ind w:left="360" w:hanging="260"/></w:pPr></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'


class _Body:
    def __init__(self, paper: str) -> None:
        self.size, self.parts, self.targets = PAPER[paper], [], []

    def run(self, text: str, bold: bool = False, url: str | None = None) -> str:
        marks = "<w:rPr><w:b/></w:rPr>" if bold else ""
        out = f'<w:r>{marks}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
        if url:
            self.targets.append(url)
            out = f'<w:hyperlink r:id="l{len(self.targets)}">{out}</w:hyperlink>'
        return out

    def rich(self, text: str, url: str | None = None, bold: bool = False) -> str:
        return "".join(self.run(part, bold or k % 2 == 1, url) for k, part in enumerate(text.split("**")) if part)

    def paragraph(self, inside: str, style: str = "Normal", right: str = "") -> None:
        tab = f'<w:tabs><w:tab w:val="right" w:pos="{self.size[0] - 2 * MARGIN}"/></w:tabs>' if right else ""
        more = f"<w:r><w:tab/></w:r>{self.run(right)}" if right else ""
        self.parts.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{tab}</w:pPr>{inside}{more}</w:p>')

    def package(self) -> bytes:
        page = f'<w:sectPr><w:pgSz w:w="{self.size[0]}" w:h="{self.size[1]}"/><w:pgMar w:top="{MARGIN}" w:right="{MARGIN}" w:bottom="{MARGIN}" w:left="{MARGIN}"/></w:sectPr>'
        links = "".join(f'<Relationship Id="l{k}" Type="{_RELS}/hyperlink" Target={quoteattr(url)} TargetMode="External"/>' for k, url in enumerate(self.targets, 1))
        own = "".join(f'<Relationship Id="{n}" Type="{_RELS}/{n}" Target="{n}.xml"/>' for n in ("styles", "numbering"))
        files = {
            "[Content_Types].xml": _TYPES,
            "_rels/.rels": _ROOT,
            "word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {_W}><w:body>{"".join(self.parts)}{page}</w:body></w:document>',
            "word/_rels/document.xml.rels": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}{links}</Relationships>',
            "word/styles.xml": _STYLES,
            "word/numbering.xml": _NUMBERING,
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in files.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)  # a fixed time: equal records give equal bytes
        return out.getvalue()


def _package(name: str, headline: str | None, line: list[dict], parts: list[dict], paper: str) -> bytes:
    body = _Body(paper)
    body.paragraph(body.run(name or ""), "Title")
    if headline:
        body.paragraph(body.rich(headline))
    body.paragraph(body.run(" | ").join(body.run(c["text"], url=c["url"]) for c in line))
    for part in parts:
        body.paragraph(body.run(part["heading"]), "Heading1")
        for block in part["blocks"]:
            for k, (left, right) in enumerate(zip(block["left"], block["right"], strict=False)):
                body.paragraph(body.rich(left, block["url"] if k == 0 else None, block["style"][k] == "primary"), right=right)
            if block["kind"] == "labeled":
                body.paragraph(body.run(block["left"][0] + ": ", True) + body.rich(block["texts"][0]))
            elif block["kind"] == "inline":
                body.paragraph(body.run(" | ").join(map(body.rich, block["texts"])))
            else:
                for text in block["texts"]:
                    body.paragraph(body.rich(text), "ListBullet" if block["kind"] == "bullets" else "Normal")
            for text in block["bullets"]:
                body.paragraph(body.rich(text), "ListBullet")
    return body.package()


def packages(docs: DataFrame, config: Config | None = None, paper: str = "a4") -> DataFrame:
    """(doc_id, docx binary) of `docs` (doc_id, resume), each row by itself."""
    config = config or Config()
    if paper not in PAPER:
        raise ValueError(f"paper {paper!r}: there are {', '.join(PAPER)}")
    resume = F.col("resume")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), resume["basics"]["name"].alias("name"), resume["basics"]["headline"].alias("headline"), contacts(resume["basics"]).alias("line"), sections(resume, config).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_package(r["name"], r["headline"], r["line"], r["parts"], paper) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "docx"])

    return rows.mapInArrow(run, "doc_id string, docx binary")
