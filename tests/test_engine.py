"""Functions, sources, records, checks, renderings, state and the watcher, on small fixtures of our own."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera import config as settings
from tessera import schema
from tessera.functions import dates, pydates, similarity, text
from tessera.operators import blocks, extract, lint, quality, verify
from tessera.plans import render, state
from tessera.sources import html, jsonresume, latex, load, markdown, plain

CONFIG = settings.Config()


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


# functions


def test_normalize(spark):
    got = column(spark, ["**Bold**  “quoted” – it’s •  x y", "", None, "A\x1cB", "ÀÉ"], text.normalize)
    assert got == ["bold \"quoted\" - it's x y", "", None, "a b", "àé"]
    assert [verify.normalized(x) for x in ("**Bold**  “quoted” – it’s •  x y", "", "A\x1cB", "ÀÉ")] == [got[0], "", "a b", "àé"]


def test_tech_tokens(spark):
    got = column(spark, ["We use PySpark, AWS, S3 and CI/CD; C#, C++, Node.js. Plain Word, a 2TB disk, AWS again.", "nothing here", None], text.tech_tokens)
    assert got == [["PySpark", "AWS", "S3", "CI/CD", "C#", "C++", "Node.js", "2TB"], [], None]


def test_numbers(spark):
    got = column(spark, ["Cut cost 30% to $1,200.50 for 5M users, 10+ in S3, 3x", "٣ apples"], text.numbers)
    assert got == [["30%", "$1,200.50", "5M", "10+", "3", "3x"], ["٣"]]


def test_small_text_functions(spark):
    assert column(spark, ["https://a.org/x//", "a.org"], text.display_url) == ["a.org/x", "a.org"]
    assert column(spark, ["a, b (c, d), ,e"], text.items) == [["a", "b (c, d)", "e"]]
    assert [[(s.text, s.bold) for s in x] for x in column(spark, ["a **b** c"], text.segments)] == [[("a ", False), ("b", True), (" c", False)]]
    assert column(spark, ["x@y.org", "x@y", "a x@y.org"], text.is_email) == [True, False, False]
    assert column(spark, ["+91 90000 00000", "12", "(020) 1234 5678"], text.is_phone) == [True, False, False]
    assert column(spark, ["I did", "My work", "time"], text.first_person) == ["I", "My", ""]
    assert column(spark, ["Responsible for x", "Led x"], text.weak_start) == [True, False]
    assert column(spark, ["Build it", "Building", "Leads", "Led", "Process x", "Focus on"], text.present_tense) == [True, True, True, False, False, False]
    assert column(spark, ["ok **b**", "bad **", "<b>x", r"\textbf{x}", "a < b"], text.markup_problem) == [None, "unbalanced **", "<b>", "\\textbf{", None]
    signs = column(spark, ["ﬁne �  bro-\n ken"], text.glyphs)[0]
    assert (signs.ligatures, signs.replacement, signs.private_use, signs.broken_words) == (["ﬁ"], True, [""], True)


RANGES = [
    ("Jun 2023 – Present", ("2023-06", "present")),
    ("2019-04 to 2021-05", ("2019-04", "2021-05")),
    ("03/2018 - 11/2019", ("2018-03", "2019-11")),
    ("2017", ("2017", None)),
    ("Sept. 2020 until now", ("2020-09", "present")),
    ("2020-02-15", ("2020-02", None)),
    ("marketing 2020", ("2020-03", None)),
    ("now", None),
    ("v2020x", None),
    ("in 2020 and 2021", None),
]


@pytest.mark.parametrize(("source", "want"), RANGES)
def test_one_range(source, want):
    assert pydates.whole_range(source) == want


def test_ranges_in_columns_are_those_of_strings(spark):
    sources = [s for s, _ in RANGES] + ["From May 2001 to June 2004, then 2010–2012; file 1999.2001/x"]
    got = column(spark, sources, dates.ranges)
    assert [[(r.start, r.end) for r in x] for x in got] == [[x[:2] for x in pydates.ranges(s)] for s in sources]
    assert [tuple(x) if x else None for x in column(spark, [s for s, _ in RANGES], dates.whole_range)] == [w for _, w in RANGES]


def test_date_forms(spark):
    assert column(spark, ["2023-06", "2017", "present", None], dates.month_index) == [2023 * 12 + 5, 2017 * 12, dates.LAST, None]
    assert column(spark, ["2023-06", "2017", "present", None], dates.shown) == ["Jun 2023", "2017", "Present", None]
    with pytest.raises(ValueError, match="date format"):
        dates.spark_pattern("%q")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(row[k], last[k + 1]))
    return row[-1]


def test_similarity(spark):
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 30))) for _ in range(2))
        assert similarity.lcs(a, b) == plain_lcs(a, b)
        assert similarity.at_least(a, b, 90) == (200 * plain_lcs(a, b) >= 90 * (len(a) + len(b)))
    assert similarity.similarity("abcd", "abxd") == 75.0
    frame = spark.createDataFrame([("abcd", "abxd"), ("a", "a"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in frame.select(similarity.ratio("a", "b")).collect()] == [75.0, 100.0, 100.0, None]
    assert [r[0] for r in frame.select(similarity.is_similar(F.col("a"), F.col("b"), 75)).collect()][:2] == [True, True]
    assert similarity.best_window("hello world", "say hello wurld now", 90) == (4, 15)
    assert similarity.best_window("absent words", "nothing alike", 90) is None


# settings


def test_settings():
    got = settings.load('date_format = "%Y"\n[heading_synonyms]\nskills = ["toolbox"]\n[html_classes]\nbox = "skip"')
    assert got.heading_synonyms["skills"] == ["toolbox"]
    assert got.heading_synonyms["awards"] == settings.HEADINGS["awards"]
    assert got.html_classes["box"] == "skip"
    assert got.html_classes["job"] == "entry:experience"
    for bad in ("colour = 1", 'section_order = ["poems"]', "x ="):
        with pytest.raises(ValueError):
            settings.load(bad)
    assert settings.keyword_lines("# note\n#tag\n\n dbt \n") == ["#tag", "dbt"]


# sources

PLAIN = """Ana  Diaz
Data Engineer
ana@x.org | +34 600 000 000 | site.org/ana

EXPERIENCE
- Built a thing
  that wraps here
Something in prose.
Skills:
Python, SQL
"""


def shape(parsed):
    return [(b.kind, b.role, b.text) for b in parsed.blocks]


def test_plain_text():
    got = plain.parse(PLAIN, CONFIG)
    assert shape(got) == [
        ("line", "name", "Ana Diaz"),
        ("line", "headline", "Data Engineer"),
        ("line", "contact", "ana@x.org"),
        ("line", "contact", "+34 600 000 000"),
        ("line", "contact", "site.org/ana"),
        ("heading", None, "EXPERIENCE"),
        ("bullet", None, "Built a thing that wraps here"),
        ("paragraph", None, "Something in prose."),
        ("heading", None, "Skills"),
        ("paragraph", None, "Python, SQL"),
    ]
    assert got.links == [{"text": "site.org/ana", "url": "https://site.org/ana"}]


MARKDOWN = """# Ana Diaz

Engineer

[ana@x.org](mailto:ana@x.org) | Madrid | [site.org](https://site.org)

## Summary

Two lines
of prose.

## Skills

**Languages:** Python, SQL

## Experience

**Acme** | Paris  
*Lead* | Jun 2020 – Present

- Did **much**

**Acme** | Rome
*Junior* | 2018 – 2019

- Did some

## Hobbies

- Chess
"""


def test_markdown():
    got = markdown.parse(MARKDOWN, CONFIG)
    assert ("line", "org", "Acme") in shape(got)
    assert ("line", "dates", "Jun 2020 – Present") in shape(got)
    assert ("line", "category", "Languages:") in shape(got)
    assert ("paragraph", None, "Two lines of prose.") in shape(got)
    assert [x["url"] for x in got.links] == ["mailto:ana@x.org", "https://site.org"]
    assert [b.new_entry for b in got.blocks if b.role == "org"] == [True, True]


HTML = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body>
<h1>Ana <b>Diaz</b></h1><div class="contact-row"><a href="mailto:ana@x.org">ana@x.org</a><span class="separator">|</span><span>Madrid</span></div>
<div class="section-title">Experience</div><!-- gone -->
<div class="job"><span class="job-company">Acme</span><span class="job-period">2020 - 2021</span><div class="job-role">Lead</div><ul><li>Did <strong>much</strong><li>More &amp; more</ul></div>
<p>One<p>Two <a href="https://a.org">link</a><div hidden>x</div><div style="display: none">y</div>
</body></html>"""


def test_html():
    got = html.parse(HTML, CONFIG)
    assert shape(got) == [
        ("line", "name", "Ana **Diaz**"),
        ("line", "contact", "ana@x.org"),
        ("line", "contact", "Madrid"),
        ("heading", None, "Experience"),
        ("line", "org", "Acme"),
        ("line", "dates", "2020 - 2021"),
        ("line", "title", "Lead"),
        ("bullet", None, "Did **much**"),
        ("bullet", None, "More & more"),
        ("paragraph", None, "One"),
        ("paragraph", None, "Two link"),
    ]
    assert [b.new_entry for b in got.blocks if b.section] == [True] + [False] * 4
    assert got.blocks[-1].url == "https://a.org"


LATEX = r"""\documentclass{moderncv}
\name{Ana}{Díaz} % a comment
\phone{+34 600 000 000}
\email{ana@x.org}
\address{Madrid}{}{}
\extrainfo{\href{https://a.org}{a.org}}
\begin{document}
\makecvtitle
\section{Experience}
\cventry{2020--2021}{Lead}{Acme \& Co}{Paris}{}{\begin{itemize}\item Saved 20\% of \textbf{time}\item Caf\'e work\end{itemize}}
\section{Summary}
One line

Next ``line'' here
\end{document} tail"""


def test_latex():
    got = latex.parse(LATEX, CONFIG)
    assert shape(got) == [
        ("line", "name", "Ana Díaz"),
        ("line", "phone", "+34 600 000 000"),
        ("line", "email", "ana@x.org"),
        ("line", "address", "Madrid"),
        ("line", "contact", "a.org"),
        ("heading", None, "Experience"),
        ("line", "dates", "2020–2021"),
        ("line", "title", "Lead"),
        ("line", "org", "Acme & Co"),
        ("line", "location", "Paris"),
        ("bullet", None, "Saved 20% of **time**"),
        ("bullet", None, "Café work"),
        ("heading", None, "Summary"),
        ("paragraph", None, "One line"),
        ("paragraph", None, "Next “line” here"),
    ]
    assert [b.role for b in got.blocks if b.new_entry] == ["dates"]


JSON = {
    "basics": {"name": "Ana", "label": "Engineer", "email": "a@x.org", "location": {"city": "Madrid", "countryCode": "ES"}, "profiles": [{"network": "Net", "url": "https://n.org/a"}], "summary": "Short."},
    "work": [{"name": "Acme", "position": "Lead", "startDate": "2020-01", "highlights": ["Did it"]}],
    "skills": [{"name": "Code", "keywords": ["Python", "SQL"]}],
    "volunteer": [{"organization": "Aid", "position": "Helper"}],
}


def test_json_resume():
    got = jsonresume.parse(json.dumps(JSON), CONFIG)
    assert ("line", "address", "Madrid, ES") in shape(got)
    assert ("line", "dates", "2020-01 - present") in shape(got)
    assert shape(got)[-2:] == [("heading", None, "Volunteer"), ("bullet", None, "Aid, Helper")]
    for bad in ("[]", "{", '{"skills": ["x"]}'):
        with pytest.raises(ValueError):
            jsonresume.parse(bad, CONFIG)


SOURCES = [("md", "a.md", MARKDOWN), ("html", "b.html", HTML), ("tex", "c.tex", LATEX), ("json", "d.json", json.dumps(JSON)), ("txt", "e.txt", PLAIN), ("bad", "f.json", "[]"), ("what", "g", "plain words"), ("none", "h.md", None), ("pdf", "i.pdf", "%PDF"), ("sniff", "j", "  <!DOCTYPE html><p>x")]


@pytest.fixture(scope="module")
def parsed(spark):
    return load.parsed(spark.createDataFrame(SOURCES, "doc_id string, path string, text string")).cache()


def test_loading_isolates_failures(parsed):
    got = {r.doc_id: r for r in parsed.collect()}
    assert {k for k, r in got.items() if r.error} == {"bad", "what", "none", "pdf"}
    assert got["sniff"].type == "html"
    assert len(got["md"].blocks) > 10


def test_files(spark, tmp_path):
    for name, content in {"a.html": b"<p>x", "out/b.html": b"x", ".h/c.tex": b"x", "d/e.tex": b"\xff\xfe", "f.md": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in load.files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.html", "e.tex"}
    assert got["e.tex"].error == "not UTF-8 text"


# records


@pytest.fixture(scope="module")
def records(parsed):
    return extract.records(parsed.where("error is null")).cache()


def test_records(records):
    got = {r.doc_id: r for r in records.collect()}
    md = got["md"].resume
    assert (md.basics.name, md.basics.headline, md.basics.email, md.basics.location) == ("Ana Diaz", "Engineer", "ana@x.org", "Madrid")
    assert [(j.company, j.title, j.location, j.start, j.end, j.bullets) for j in md.experience] == [("Acme", "Lead", "Paris", "2020-06", "present", ["Did **much**"]), ("Acme", "Junior", "Rome", "2018", "2019", ["Did some"])]
    assert [(s.category, s.items) for s in md.skills] == [("Languages", ["Python", "SQL"])]
    assert [(e.title, e.after, e.items) for e in md.extra_sections] == [("Hobbies", "experience", ["Chess"])]
    assert md.summary == "Two lines of prose."
    assert got["md"].unplaced == []
    assert got["tex"].resume.experience[0].company == "Acme & Co"
    assert got["tex"].resume.basics.links[0].url == "https://a.org"
    assert got["json"].resume.skills[0]["items"] == ["Python", "SQL"]
    assert got["html"].resume.experience[0].title == "Lead"
    assert got["sniff"].problems == ["basics.name: missing"]


def test_nothing_is_lost(records):
    """Every block ends in the record."""
    for r in records.collect():
        held = json.dumps(r.resume.asDict(True), ensure_ascii=False)
        for b in r.blocks:
            if b.kind in ("bullet", "paragraph"):
                assert json.dumps(b.text, ensure_ascii=False)[1:-1] in held


def test_an_incomplete_entry_is_kept_verbatim():
    source = [extract.Block("heading", "Experience"), extract.Block("line", "Acme", role="org", new_entry=True), extract.Block("bullet", "Did it")]
    record, unplaced = extract.mapped(source, CONFIG)
    assert "experience" not in record
    assert record["extra_sections"] == [{"title": "Experience", "after": "experience", "items": ["Acme", "Did it"]}]
    assert unplaced == ["Experience: Acme", "Experience: Did it"]


def test_dropped_sections(spark, parsed):
    source = spark.createDataFrame([("x", "a.md", "# Ana\n\n## References\n\n- gone\n\n### Inner\n\n- stays\n")], "doc_id string, path string, text string")
    docs = load.parsed(source)
    got = blocks.without_dropped(docs, CONFIG).first()
    assert got.dropped == ["heading: References", "bullet: gone"]
    assert [b.text for b in got.blocks] == ["Ana", "Inner", "stays"]
    long = blocks.split_dropped(load.blocks(docs), ("references",)).orderBy("seq").collect()
    assert [r.text for r in long if r.dropped] == ["References", "gone"]


def test_source_headings(spark):
    rows = [("d", 0, "heading", "Work Experience", None), ("d", 1, "bullet", "x", None), ("d", 2, "heading", "Odd Title", None), ("d", 3, "line", "y", "projects"), ("d", 4, "line", "z", "awards")]
    got = blocks.source_headings(spark.createDataFrame(rows, "doc_id string, seq int, kind string, text string, section string"), CONFIG).collect()
    assert {(r.section, r.heading) for r in got} == {("experience", "Work Experience"), ("projects", "Odd Title")}


# verification


def tampered(records, change):
    resume = schema.struct(schema.RESUME)
    row = records.where("doc_id = 'md'").first()
    value = row.resume.asDict(True)
    change(value)
    spark = records.sparkSession
    return spark.createDataFrame([(row.doc_id, [b.asDict() for b in row.blocks], [x.asDict() for x in row.links], schema.conform(value, resume))], records.select("doc_id", "blocks", "links", "resume").schema)


def found(records, change=lambda r: None, config=None):
    return {(r.name, r.detail) for r in verify.verified(tampered(records, change), config).collect()}


def test_an_untouched_record_passes(records):
    assert found(records) == set()


MUTATIONS = [
    (lambda r: r["experience"][0]["bullets"].append("Invented 40% growth"), {("No additions", "Invented 40% growth"), ("Numbers", "40%")}),
    (lambda r: r["experience"][0].update(company="Bcme"), {("No additions", "Bcme")}),
    (lambda r: r["experience"][0].update(bullets=[]), {("Coverage", "bullet: Did **much**")}),
    (lambda r: r["experience"][0].update(end="2021"), {("No additions", "2020-06 to 2021")}),
    (lambda r: r["skills"][0].update(items=["Python"]), {("Coverage", "line: Python, SQL"), ("Keywords", "SQL")}),
    (lambda r: r["basics"]["links"].append({"url": "https://evil.org"}), {("No additions", "https://evil.org")}),
    (lambda r: r["meta"].update(headings={"experience": "My Jobs"}), {("No additions", "My Jobs")}),
    (lambda r: r.update(summary="Two lines of other prose, which is longer."), {("No additions", "Two lines of other prose, which is longer."), ("Coverage", "paragraph: Two lines of prose.")}),
]


@pytest.mark.parametrize("case", range(len(MUTATIONS)))
def test_a_change_fails_its_check(records, case):
    change, want = MUTATIONS[case]
    assert want <= found(records, change)


def test_order(records):
    def swap(r):
        r["experience"][0]["bullets"] = ["Did some", "Did **much**"]
        r["experience"][1]["bullets"] = []

    assert ("Order", "not in source order") in found(records, swap)


def test_roll_up(spark, records):
    findings = verify.verified(tampered(records, MUTATIONS[1][0]))
    docs = spark.createDataFrame([("md",), ("other",)], "doc_id string")
    got = {r.doc_id: r for r in verify.rolled_up(docs, findings).collect()}
    assert not got["md"].passed
    assert got["other"].passed


# lint


def record_frame(spark, *records):
    kind = schema.struct(schema.RESUME)
    from pyspark.sql import types as T

    rows = [(str(k), schema.conform(r, kind)) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("resume", kind)]))


def test_lint(spark):
    job = lambda **x: {"company": "A", "title": "T", "start": "2019-01", "end": "2020-01", "bullets": []} | x
    frame = record_frame(
        spark,
        {"basics": {"name": "N"}, "experience": [job(bullets=["x" * 221, "Responsible for this", "I did my part", "Builds pipelines"])]},
        {"basics": {"name": "N"}, "summary": "My " + "y" * 420, "experience": [job(), job(start="2019-06", end="present"), job(start="2018", end=None)], "education": [{"institution": "U"}]},
        {"basics": {"name": "N"}, "skills": [{"category": "c", "items": [f"i{k}" for k in range(36)]}], "experience": [job(bullets=[f"Used AWS for case number {k * 1111}" for k in range(4)] + ["Same text here now", "Same text here now!"])]},
        {"basics": {"name": "N"}, "experience": [job(bullets=["Led a team"])]},
    )
    got = {(r.doc_id, r.name, r.location) for r in lint.linted(frame).collect()}
    at = lambda k: f"experience[0].bullets[{k}]"
    assert {x[1:] for x in got if x[0] == "0"} == {("long-bullet", at(0)), ("weak-start", at(1)), ("first-person", at(2)), ("tense", at(3))}
    assert {x[1:] for x in got if x[0] == "1"} == {("first-person", "summary"), ("long-summary", "summary"), ("missing-date", "experience[2]"), ("missing-date", "education[0]"), ("mixed-dates", "experience"), ("overlapping-dates", "experience[0] and experience[1]")}
    assert ("2", "keyword-repeat", "bullets") in got
    assert ("2", "many-skills", "skills") in got
    assert ("2", "duplicate-bullet", f"{at(4)} and {at(5)}") in got
    assert not [x for x in got if x[0] == "3"]


# renderings


def test_markdown_round_trip(spark, records):
    md = records.where("doc_id = 'md'").select("resume", render.rendered(F.col("resume"), markdown=True).alias("text")).first()
    again = extract.records(load.parsed(spark.createDataFrame([("r", "r.md", md.text)], "doc_id string, path string, text string"))).first()
    assert again.resume.asDict(True) == md.resume.asDict(True)


def test_plain_rendering(records):
    got = records.where("doc_id = 'md'").select(render.rendered(F.col("resume"))).first()[0]
    assert got.splitlines()[:3] == ["Ana Diaz", "Engineer", "ana@x.org | Madrid | site.org"]
    assert "EXPERIENCE\nAcme | Paris\nLead | Jun 2020 – Present\n- Did much\n\nAcme | Rome" in got
    assert got.endswith("- Chess\n")


def test_grouped_roles(records):
    config = settings.Config(group_roles=True)
    got = records.where("doc_id = 'md'").select(render.rendered(F.col("resume"), config)).first()[0]
    assert "EXPERIENCE\nAcme\nLead | Paris | Jun 2020 – Present\n- Did much\nJunior | Rome | 2018 – 2019" in got


def test_section_order(records):
    config = settings.Config(section_order=("experience", "summary"))
    got = records.where("doc_id = 'md'").select(render.headings(F.col("resume"), config)).first()[0]
    assert got == ["Experience", "Hobbies", "Summary", "Skills"]


def test_json_export(spark, records):
    got = json.loads(records.where("doc_id = 'md'").select(render.json_resume(F.col("resume"))).first()[0])
    assert got["work"][0] == {"name": "Acme", "position": "Lead", "location": "Paris", "startDate": "2020-06", "highlights": ["Did much"]}
    assert "education" not in got
    again = extract.records(load.parsed(spark.createDataFrame([("r", "r.json", json.dumps(got))], "doc_id string, path string, text string"))).first()
    assert [j.company for j in again.resume.experience] == ["Acme", "Acme"]


def test_yaml_round_trip(records):
    text_ = render.yaml_text(records)
    assert "start: 2018" in text_.where("doc_id = 'md'").first().yaml
    back = {r.doc_id: r for r in render.yaml_records(text_).collect()}
    for r in records.collect():
        assert back[r.doc_id].resume.asDict(True) == r.resume.asDict(True)
    bad = records.sparkSession.createDataFrame([("b", "basics: {name: N, age: 3}\nsummary: '<b>x'"), ("c", ": [")], "doc_id string, yaml string")
    wrong = {r.doc_id: r.problems for r in render.yaml_records(bad).collect()}
    assert "basics.age: unknown key" in wrong["b"]
    assert any("markup" in x for x in wrong["b"])
    assert wrong["c"][0].startswith("not YAML")


def test_output_names(spark):
    frame = spark.createDataFrame([("Ana María Díaz-Ruiz", "Acme, Inc."), ("X", None)], "a string, b string")
    assert [r[0] for r in frame.select(render.output_name(F.col("a"), F.col("b"))).collect()] == ["Ana_María_DíazRuiz_Resume_Acme_Inc", "X_Resume"]


# checks of extracted text


def test_checks_pass_on_our_own_rendering(records):
    docs = records.where("doc_id in ('md', 'tex')").select("doc_id", "resume", render.headings(F.col("resume")).alias("headings"), render.flat_items(F.col("resume")).alias("expected"), render.rendered(F.col("resume")).alias("text"))
    got = quality.checked(docs).collect()
    assert {(r.name, r.detail) for r in got} == {("Headings", "Hobbies")}
    broken = docs.withColumn("text", F.concat(F.lit("x\ny\n"), F.regexp_replace("text", "Did much", "")))
    names = {r.name for r in quality.checked(broken).collect() if r.doc_id == "md"}
    assert {"Name", "Content and order"} <= names


def test_content_order():
    assert quality.placed(["alpha beta", "gamma delta", "missing item"], "gamma delta then alpha beta") == [(1, "misplaced"), (2, "missing")]
    assert quality.placed(["a long sentence with a typo"], "a long sentence with a typp") == []


def test_text_only_checks(spark):
    assert column(spark, ["mail a@b.org or +34 600 000 000", "nothing"], quality.contacts_absent) == [[], ["no email address found", "no phone number found"]]
    assert column(spark, ["Experience\nx\nEDUCATION", "x"], quality.basic_headings_missing) == [[], ["Experience", "Education"]]
    frame = spark.createDataFrame([("We use AWS, Snowflake and dbt", "aws only")], "a string, b string")
    got = frame.select(quality.keyword_coverage(F.col("a"), F.col("b")).alias("k")).first().k
    assert (got.found, got.missing) == (["AWS"], ["Snowflake"])


def test_stacked_roles_and_links(records):
    md = records.where("doc_id = 'md'")
    assert md.select(quality.stacked_roles(F.col("resume.experience"))).first()[0] == ["Junior"]
    assert md.select(quality.links_not_clickable(F.col("resume"), F.array(F.lit("x")))).first()[0] == ["https://site.org"]


# state and watching


def test_states(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "doc_id string, content string")
    passed = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "doc_id string, passed boolean")
    record = state.recorded(docs, passed)
    now = docs.withColumn("content", F.when(F.col("doc_id") == "b", "new").otherwise(F.col("content")))
    assert {r.doc_id: r.state for r in state.states(now, record).collect()} == {"a": "passed", "b": "edited", "c": "failed", "d": "unverified"}
    findings = spark.createDataFrame([("a", "lint", 1), ("a", "lint", 2), ("a", "verify", 1)], "doc_id string, stage string, run int")
    assert state.latest(findings, "run").count() == 2


def test_watch(spark, tmp_path):
    from tessera.streaming.watch import FolderReader, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.html").write_text("<p>old")
    reader = FolderReader([str(tmp_path / "in")], 0.0)
    offset = reader.initialOffset()
    (tmp_path / "in" / "new.html").write_text("<p>new")
    rows, offset = reader.read(offset)
    assert list(rows) == []
    rows, offset = reader.read(offset)
    assert [r[0].rsplit("/", 1)[1] for r in rows] == ["new.html"]
    rows, offset = reader.read(offset)
    assert list(rows) == []

    seen = []

    def handle(files):
        seen.extend(r.path.rsplit("/", 1)[1] for r in files.collect())
        raise RuntimeError("does not stop the stream")

    stream = watch(spark, [str(tmp_path / "in")], handle, str(tmp_path / "checkpoint"), interval=0.2)
    try:
        time.sleep(4)
        for name in ("one.tex", "two.html"):
            (tmp_path / "in" / name).write_text("x")
            deadline = time.time() + 30
            while name not in seen and time.time() < deadline:
                time.sleep(0.3)
    finally:
        stream.stop()
    assert seen == ["one.tex", "two.html"]
    with pytest.raises(ValueError):
        watch(spark, [str(tmp_path / "none")], handle, str(tmp_path / "c2"))


# whole runs, word-processor files and pages


def test_run(spark):
    from tessera.plans import run

    sources = spark.createDataFrame(SOURCES, "doc_id string, path string, text string").where("doc_id in ('md', 'tex', 'bad', 'sniff')")
    out = run.run(sources)
    assert {r.doc_id for r in out.errors.collect()} == {"bad"}
    assert {r.doc_id: r.passed for r in out.passed.collect()} == {"md": True, "tex": True, "sniff": False}
    got = {(r.doc_id, r.stage, r.name) for r in out.findings.collect()}
    assert ("sniff", "ingest", "Schema") in got
    assert ("md", "check", "Headings") in got
    md = out.records.where("doc_id = 'md'").first().resume
    assert md.meta.headings == {"summary": "Summary", "skills": "Skills", "experience": "Experience"}
    assert run.recorded(out).count() == 3
    with pytest.raises(ValueError):
        run.run(sources, extractor="oracle")


def test_formats(records):
    import io
    import xml.dom.minidom
    import zipfile

    from tessera.plans import run

    got = run.rendered(records.where("doc_id = 'md'")).first()
    assert got.name == "Ana_Diaz_Resume"
    with zipfile.ZipFile(io.BytesIO(bytes(got.docx))) as z:
        parts = {n: xml.dom.minidom.parseString(z.read(n)) for n in z.namelist()}
    body = parts["word/document.xml"].documentElement
    words = "".join(t.firstChild.data for t in body.getElementsByTagName("w:t") if t.firstChild)
    for piece in ("Ana Diaz", "Acme", "Jun 2020 – Present", "Did ", "much", "Python, SQL", "Chess"):
        assert piece in words
    assert not body.getElementsByTagName("w:tbl")
    assert "https://site.org" in parts["word/_rels/document.xml.rels"].toxml()
    with pytest.raises(ValueError):
        run.rendered(records, formats=("pdf",))


def test_batch(spark, tmp_path):
    from tessera.plans import run

    for name in ("a/cv.html", "b/cv.html"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(HTML)
    (tmp_path / "b" / "odd.tex").write_bytes(b"\xff")
    out = run.batch(spark, str(tmp_path))
    assert out.records.count() == 2
    assert out.errors.count() == 1


def test_pages(spark, records):
    from tessera.plans import pages

    rows = [("a", 1, 595.3, 841.9, "text", [("F", True)], 100), ("b", 1, 612.0, 792.0, " ", [("F", False)], 3_000_000), ("b", 2, 595.3, 841.9, "x", [], 3_000_000), ("b", 3, 595.3, 841.9, "x", [], 3_000_000)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, width double, height double, text string, fonts array<struct<name:string,embedded:boolean>>, file_bytes long")
    got = sorted(r.detail for r in pages.hygiene(frame).collect())
    assert got == ["3 pages, limit is 2", "3.00 MB, limit is 2.0", "page 1 has no text", "page 1 is not a4", "page 1: font F is not embedded"]
    words = spark.createDataFrame([("d", p, line, 100.0 + line, 50.0, 50.0, 800.0) for p in (1, 2, 3) for line in range(4)], "doc_id string, page int, line int, bottom double, top_margin double, bottom_margin double, height double")
    r = pages.overflow(words, 2).first()
    assert (r.pages, r.beyond) == (3, 4)
    assert r.fill == pytest.approx(53 / 700)
    top = records.where("doc_id = 'md'").select(pages.longest(render.sections(F.col("resume"), CONFIG)).alias("x")).first().x
    assert top.sections[0].text == "Experience"
    assert [b.characters for b in top.bullets] == [12, 8, 5]
    fitted = pages.fit({"size": 10.0}, {"size": 8.0}, lambda s: (1 if s["size"] <= 9 else 2, 0.5), 1)
    assert (fitted.fits, fitted.tries, fitted.settings) == (True, 3, {"size": 9.0})
    assert pages.fit({"size": 10.0}, {"size": 8.0}, lambda s: (2, 0.5), 1) == pages.Fit({"size": 10.0}, 2, False, 8)
    assert pages.fit({"size": 10.0}, {}, lambda s: (2, 0.1), 2).warning == "the last page is 10% full"


def test_passage_containment(spark, tmp_path):
    """Items glued to signs, items of few words and none, null ids and repeated rows, against plain containment."""
    from tessera.queries import passage_containment

    texts = ['he said "alpha beta gamma delta eps zeta" end', "one two three four five six", "(alpha beta gamma delta eps, zeta", "xalpha beta gamma delta epsy", "nothing here", "", None]
    docs = [*enumerate(texts), (None, texts[0]), (1, texts[1]), (1, texts[0])]
    items = [(10, "alpha beta gamma delta eps zeta"), (11, "two three four"), (12, "alpha beta gamma delta eps"), (13, "three"), (14, "hree fo"), (15, ""), (16, None), (17, "absent words of no text at all"), (18, "beta gamma delta"), (11, "two three four"), (None, "one two three four five six")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = passage_containment(spark, f"file://{tmp_path}").collect()
    want = [(i, k) for i, t in docs for k, n in items if t is not None and n is not None and n in t]
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((str(i), str(k)) for i, k in want)


def test_html_title(spark, tmp_path):
    """References cut short or not in the SQL's list, pages without a title, null and repeated pages, against the query's own SQL."""
    import duckdb

    from tessera.queries import ORACLE_SQL, html_title

    titles = ["the&amp;&amp;&amp", "token = &quot", "a &am", "a &a", "&", "&&amp;", "&amp;lt; &amp;amp;", "a&nbsp;b &nbsp", "&lt;b&gt; &#39;x&#39; &#39", "&copy; 2024 &copy 2024 &notit &eacute; &#233;", "&AMP; &LT;", "a \n b\t", "", "&quot;A &am&lt;p;&quot;"]
    pages = [f'<!DOCTYPE html><html><head><title>{t}</title><script>var t="</p>&amp";</script></head><body><div class="ad">x</div><article><h1 id="t">{t}</h1><p>&amp</p><h1>2</h1></article></body></html>' for t in titles]
    pages += ["<html><body><p>none</p></body></html>", "", None]
    rows = [*enumerate(pages), (0, pages[0]), (0, pages[1]), (None, pages[2])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = db.execute(ORACLE_SQL["html_title"]).fetchall()
    got = [tuple(r) for r in html_title(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (0, "the&&&amp") in got
    assert len(got) == len(rows)
