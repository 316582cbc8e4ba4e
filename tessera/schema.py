"""Shapes of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: A source document as blocks in order.
BLOCK = "kind string, text string, level int, role string, url string, new_entry boolean, section string"
LINK = "text string, url string"
BLOCKS = f"doc_id string, seq int, {BLOCK}"
FINDINGS = "doc_id string, stage string, name string, status string, location string, detail string"

#: A record: nested, with dates as strings.
RESUME = (
    "meta struct<source_file:string,source_tool:string,target_role:string,target_company:string,headings:map<string,string>>,"
    "basics struct<name:string,headline:string,email:string,phone:string,location:string,links:array<struct<label:string,url:string,text:string>>>,"
    "summary string,"
    "skills array<struct<category:string,items:array<string>>>,"
    "experience array<struct<company:string,title:string,location:string,start:string,end:string,bullets:array<string>>>,"
    "projects array<struct<name:string,url:string,tech:array<string>,description:string,bullets:array<string>>>,"
    "education array<struct<institution:string,degree:string,field:string,location:string,start:string,end:string,details:array<string>>>,"
    "certifications array<struct<name:string,issuer:string,date:string>>,"
    "awards array<struct<title:string,awarder:string,date:string>>,"
    "publications array<struct<name:string,publisher:string,date:string,url:string>>,"
    "languages array<struct<language:string,fluency:string>>,"
    "extra_sections array<struct<title:string,after:string,items:array<string>>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def json_schema() -> str:
    """The record's schema as JSON."""
    return struct(RESUME).json()


def empty_record(kind: T.DataType):
    """A value of a schema with nothing in it: lists empty, all else null."""
    if isinstance(kind, T.StructType):
        return {f.name: empty_record(f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return []
    return {} if isinstance(kind, T.MapType) else None


def conform(value, kind: T.DataType, path: str = "", problems: list[str] | None = None):
    """`value` with exactly the fields of the schema; what does not fit is named in `problems`, never dropped in silence."""
    problems = [] if problems is None else problems
    if value is None:
        return empty_record(kind) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            problems.append(f"{path or 'record'}: not a mapping")
            return empty_record(kind)
        problems += [f"{path}{'.' if path else ''}{k}: unknown key" for k in value if k not in kind.names]
        return {f.name: conform(value.get(f.name), f.dataType, f"{path}{'.' if path else ''}{f.name}", problems) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            problems.append(f"{path}: not a list")
            return []
        return [conform(x, kind.elementType, f"{path}[{i}]", problems) for i, x in enumerate(value)]
    if isinstance(kind, T.MapType):
        return {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else {}
    if isinstance(value, (dict, list)):
        problems.append(f"{path}: not a text")
        return None
    return str(value)
