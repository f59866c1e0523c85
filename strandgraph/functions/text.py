"""SQL text, routes, URLs, names and source positions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
_NAME = r"[`\"\[]?([A-Za-z_][\w$]*(?:[`\"\]]?\.[`\"\[]?[A-Za-z_][\w$]*)*)[`\"\]]?"


def bare_name(name: Column) -> Column:
    """A table name without quotes and schema, lower-case."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"[`\"\[\]]", ""), r"([^.]+)$", 1))


def sql_table(statement: Column) -> Column:
    """The table of a statement that names only one; null for joins and nested selects."""
    froms = F.size(F.regexp_extract_all(statement, F.lit(r"(?i)\bfrom\b"), F.lit(0)))
    name = F.regexp_extract(statement, rf"(?i)\b(?:from|into|update)\s+(?:only\s+)?{_NAME}", 1)
    single = ~statement.rlike(r"(?i)\bjoin\b") & (froms <= 1) & (name != "")
    return F.when(single, bare_name(name))


def from_table(statement: Column) -> Column:
    """The first table behind FROM, unless it belongs to the system."""
    raw = F.regexp_extract(statement, rf"(?i)\b(?:from|into|update)\s+{_NAME}", 1)
    schema = F.lower(F.regexp_extract(F.regexp_replace(raw, r"[`\"\[\]]", ""), r"^(?:.*\.)?([^.]+)\.[^.]+$", 1))
    system = schema.isin(*SYSTEM_SCHEMAS) | F.lower(raw).startswith("pg_")
    return F.when((raw != "") & ~system, bare_name(raw))


_KEYWORDS = frozenset("and or not null is in like ilike between exists true false as asc desc by on case when then else end distinct all any some select from where set values limit offset order group having returning default".split())


def columns_of(statement: str | None) -> list[str]:
    """Columns a single-table statement reads or writes: lower-case, distinct, in order.

    Functions, stars, literals, aliases and qualifiers are dropped.
    """
    if not statement:
        return []
    s = re.sub(r"'(?:[^']|'')*'", " ", statement)
    s = re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.S)
    s = re.sub(r"\s+", " ", s).strip().rstrip(";")
    out: list[str] = []

    def add(name: str) -> None:
        name = name.strip().strip('`"[]').split(".")[-1].strip('`"[]').lower()
        if re.fullmatch(r"[a-z_][\w$]*", name) and name not in _KEYWORDS and name not in out:
            out.append(name)

    def conditions(text: str) -> None:
        text = re.split(r"(?i)\b(?:order by|group by|limit|offset|returning|having)\b", text)[0]
        for m in re.finditer(r"([`\"\[]?[A-Za-z_][\w$]*[`\"\]]?(?:\.[`\"\[]?[A-Za-z_][\w$]*[`\"\]]?)*)\s*(?:=|<>|!=|<=|>=|<|>|\s+(?:not\s+)?(?:in|like|ilike|between|is)\b)", text, re.I):
            add(m[1])

    where = re.search(r"(?i)\bwhere\b(.*)$", s)
    if m := re.match(r"(?i)insert into [^(]+\(([^)]*)\)", s):
        for part in m[1].split(","):
            add(part)
    elif m := re.match(r"(?i)update \S+(?: (?:as )?\w+)? set (.*?)(?: where .*)?$", s):
        depth, part, parts = 0, "", []
        for c in m[1]:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for p in [*parts, part]:
            add(p.split("=")[0])
    elif m := re.match(r"(?i)select (?:distinct )?(.*?) from ", s):
        for p in re.sub(r"\([^()]*\)", "()", m[1]).split(","):
            p = re.sub(r"(?i)\s+as\s+.*$", "", p.strip())
            if "(" not in p and "*" not in p:
                add(p.split(" ")[0])
    if where:
        conditions(where[1])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_columns(statements: pd.Series) -> pd.Series:
    """columns_of as an Arrow-batched function: a grammar, not a pattern, so no built-in fits."""
    return statements.map(columns_of)


def canonical_template(path: Column) -> Column:
    """A route template without query and fragment, with a leading and no trailing slash."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def normalised_template(path: Column) -> Column:
    """The template with every dynamic segment as :param and the rest lower-case."""
    dynamic = r"^(?:[:*].*|\{.*\}|\[.*\]|<.*>|\$\{.*\}|\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{24,})$"
    parts = F.transform(F.split(canonical_template(path), "/"), lambda s: F.when(s.rlike(dynamic), ":param").otherwise(F.lower(s)))
    return F.array_join(parts, "/")


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL or path text, without query; / if there is none."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(rest, r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def connection(url: Column) -> Column:
    """struct<scheme, host, port, database> of a connection string."""
    pattern = r"^([A-Za-z][A-Za-z0-9+]*)://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?,]+)?(?::(\d+))?(?:[^/]*/([^?;]*))?"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("host"), part(3).try_cast("int").alias("port"), part(4).alias("database"))


# Schemes and images of database engines.
ENGINE_OF_SCHEME = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mysql2": "mysql", "mariadb": "mysql", "mongodb": "mongodb", "mongodb+srv": "mongodb", "redis": "redis", "rediss": "redis", "sqlite": "sqlite", "sqlserver": "mssql", "mssql": "mssql"}
ENGINE_OF_IMAGE = {"postgres": "postgresql", "postgis": "postgresql", "mysql": "mysql", "mariadb": "mysql", "mongo": "mongodb", "redis": "redis"}


def engine_of_scheme(scheme: Column) -> Column:
    out = None
    for k, v in ENGINE_OF_SCHEME.items():
        out = (F.when if out is None else out.when)(F.lower(scheme) == k, v)
    return out


def engine_of_image(image: Column) -> Column:
    """struct<engine, version> of a container image; null engine for other images."""
    base = F.regexp_extract(image, r"([^/:@]+)(?::[^/]*)?(?:@.*)?$", 1)
    tag = F.regexp_extract(image, r":([^/:@]+)(?:@.*)?$", 1)
    engine = None
    for k, v in ENGINE_OF_IMAGE.items():
        engine = (F.when if engine is None else engine.when)(F.lower(base) == k, v)
    return F.struct(engine.alias("engine"), F.nullif(F.regexp_extract(tag, r"^(\d+(?:\.\d+)*)", 1), F.lit("")).alias("version"))


def iso_from_nanos(nanos: Column) -> Column:
    """ISO time to the millisecond, cut off; null for 0 or none."""
    ms = F.when(nanos > 0, ((nanos - F.pmod(nanos, F.lit(1_000_000))) / 1_000_000).cast("long"))
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(__tests__|__fixtures__|integration-tests)(/|$)|_test\.go$|\.(spec|test)\.[A-Za-z]+$")


_IRREGULAR = {"person": "people", "child": "children", "man": "men", "woman": "women", "mouse": "mice", "goose": "geese"}
_SAME = frozenset("sheep fish series species news data information equipment money".split())


def plural(word: str) -> str:
    """English plural, as object mappers derive table and collection names."""
    low = word.lower()
    if low in _SAME or not low:
        return word
    if low in _IRREGULAR:
        return _IRREGULAR[low]
    if re.search(r"[^aeiou]y$", low):
        return word[:-1] + "ies"
    if re.search(r"(s|x|z|ch|sh)$", low):
        return word + "es"
    return word + "s"


def singular(word: str) -> str:
    low = word.lower()
    for one, many in _IRREGULAR.items():
        if low == many:
            return one
    if low in _SAME:
        return word
    if low.endswith("ies") and len(low) > 3:
        return word[:-3] + "y"
    if re.search(r"(ses|xes|zes|ches|shes)$", low):
        return word[:-2]
    return word[:-1] if low.endswith("s") and not low.endswith("ss") else word


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def line_of(content: str, at: int) -> int:
    """Line (from 1) of a position in a text."""
    return content.count("\n", 0, at) + 1


def snippet(content: str, line: int) -> str:
    """A line of a text, trimmed."""
    lines = content.split("\n")
    return lines[line - 1].strip() if 0 < line <= len(lines) else ""


def mask_comments(content: str, hash_comments: bool = False) -> str:
    """The text with comments blanked out, every other character at its place."""
    line = r"#[^\n]*" if hash_comments else r"//[^\n]*"
    token = re.compile(rf"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|({line}|/\*.*?\*/)", re.S)
    return token.sub(lambda m: m[1] if m[1] is not None else re.sub(r"[^\n]", " ", m[2]), content)
