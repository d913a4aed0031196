"""Operations of GraphQL documents, and escapes of texts for JSON and markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"#[^\n]*|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|\.\.\.|[A-Za-z_]\w*|\S", re.S)
_KINDS = ("query", "mutation", "subscription")
OPERATION = "type string, name string, root_fields array<string>"


def operation(document: str | None) -> tuple[str, str | None, list[str]] | None:
    """Kind, name and root fields (aliases where there are) of the first operation; None if there is none, as in fragments."""
    words = [t for t in _TOKEN.findall((document or "").strip("`")) if t[0] not in "#\""]
    start = next((k for k, t in enumerate(words) if t in _KINDS), None)
    if start is None:
        if words[:1] != ["{"]:
            return None
        kind, name, at = "query", None, 0
    else:
        kind = words[start]
        after = words[start + 1] if start + 1 < len(words) else ""
        name = after if re.fullmatch(r"[A-Za-z_]\w*", after) else None
        at = next((k for k in range(start, len(words)) if words[k] == "{"), len(words))
    fields, depth, rounds, ready = [], 0, 0, True
    for k, t in enumerate(words[at:], at):
        if t in "()":
            rounds += 1 if t == "(" else -1
        elif rounds:
            continue
        elif t in "{}":
            depth += 1 if t == "{" else -1
            if not depth:
                break
        elif depth == 1:
            if t in ("...", "on") or words[k - 1] in ("...", "on", ":", "@"):
                continue
            if t[0].isalpha() or t[0] == "_":
                fields.append(t)
    return kind, name, list(dict.fromkeys(fields))


def parse_operation(document: Column) -> Column:
    @F.pandas_udf(OPERATION)
    def parse(documents: pd.Series) -> pd.DataFrame:
        found = [operation(x) or (None, None, None) for x in documents]
        return pd.DataFrame(found, columns=["type", "name", "root_fields"])

    return parse(document)


def escape_json(text: Column) -> Column:
    """As it stands between quotes in a JSON document that is put into a page: < is \\u003c, too."""
    inner = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), F.replace(inner.substr(F.lit(7), F.length(inner) - 8), F.lit("<"), F.lit("\\u003c")))


def escape_markup(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def glob(path: Column, pattern: str) -> Column:
    """** stands for any folders, * for signs within a name, ? for one of them; {a,b} for either."""
    out, k, inside = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:[^/]*/)*", k + 2
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, inside = out + "(?:", inside + 1
        elif c == "}" and inside:
            out, inside = out + ")", inside - 1
        elif c == "," and inside:
            out += "|"
        else:
            out += re.escape(c)
        k += 1
    return F.regexp_like(path, F.lit(rf"\A{out}\z"))
