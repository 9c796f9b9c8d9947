"""Declarations and calls of Java sources: a lexer and a stack of open braces find types, nested ones too, their fields, methods and calls; who is called follows from joins over the tables of all files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.workspace import Workspace

_HIDDEN = re.compile(r'"""(?s:.*?)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*(?s:.*?)\*/')
_TOKEN = re.compile(r"@?[A-Za-z_$][\w$]*|[{}();]|[^\s\w$]|\d[\w.]*")
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)(.*)", re.S)
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*\s*\.\s*)*)([A-Za-z_$][\w$]*)\s*\(")
_LOCAL = re.compile(r"\b([A-Z][\w$]*(?:\s*\.\s*[A-Z][\w$]*)*)\s*(?:<[^;(){}]*>)?\s*(?:\[\s*\]|\.\.\.)*\s+([a-z_$][\w$]*)\s*(?=[=;:,)]|$)")
_VAR = re.compile(r"\bvar\s+([a-z_$][\w$]*)\s*=\s*new\s+([A-Z][\w$.]*)")
#: Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return synchronized super this try assert throw new else do case".split())
SCHEMA = "path string, package string, type string, outer string, kind string, form string, name string, bases array<string>, imports array<string>, first int, last int, text string, calls array<struct<how:string,of:string,name:string>>"


def hidden(text: str) -> str:
    """The text with comments and what is in literals blanked out; every place and line stays."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    return _HIDDEN.sub(lambda m: m[0][0] + blank(m[0][1:-1]) + m[0][0] if m[0][0] in "\"'" else blank(m[0]), text)


def _plain(text: str) -> str:
    """Without type arguments and annotations."""
    while (less := re.sub(r"<[^<>]*>", " ", text)) != text:
        text = less
    return re.sub(r"@(?!interface\b)[\w$.]+(?:\s*\([^()]*\))?", " ", text)


def _variables(text: str) -> dict[str, str]:
    found = {m[2]: re.sub(r"\s", "", m[1]) for m in _LOCAL.finditer(text)}
    return found | {m[1]: m[2] for m in _VAR.finditer(text)}


class _Type:
    def __init__(self, name: str, form: str, bases: list[str], outer: _Type | None, at: int):
        self.name, self.form, self.bases, self.outer, self.at, self.end, self.fields = name, form, bases, outer, at, at, {}


def outline(text: str) -> tuple[str, list[str], list[_Type], list[tuple[_Type, str, int, int, str]]]:
    """Package, imports, types, and methods (type, name, begin, end, parameters) of a source. What isn't closed ends with the text."""
    code = hidden(text)
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code)
    imports = re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code)
    types, methods, stack, begin, depth = [], [], [], 0, 0

    def fields(head: str, of: _Type) -> None:
        if "(" not in head.split("=")[0]:
            of.fields |= _variables(_plain(head.split("=")[0]).strip() + ";")

    for m in _TOKEN.finditer(code):
        c, here = m[0], stack[-1][1] if stack else None
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == ";" and not depth:
            head = _plain(code[begin : m.start()])
            if isinstance(here, _Type):
                if "(" in head.split("=")[0]:
                    name = re.search(r"([A-Za-z_$][\w$]*)\s*\(", head)
                    if name and re.match(r"[\s\w$.\[\]]*\w\s+[A-Za-z_$][\w$]*\s*\($", head[: name.end()]):
                        methods.append((here, name[1], begin, m.end(), ""))
                else:
                    fields(code[begin : m.start()], here)
            begin = m.end()
        elif c == "{":
            head, opened = _plain(code[begin : m.start()]), None
            declared = _TYPE.search(head)
            if declared and (here is None or isinstance(here, _Type) or here[0] == "method") and "=" not in head[: declared.start()]:
                enclosing = next((x for _, x in reversed(stack) if isinstance(x, _Type)), None)
                rest = re.sub(r"\([^()]*\)", " ", declared[3])
                bases = [b.strip() for b in re.sub(r"\b(extends|implements|permits)\b", ",", rest).split(",") if b.strip()]
                opened = _Type(declared[2], declared[1], bases, enclosing, begin)
                types.append(opened)
            elif isinstance(here, _Type):
                name = re.search(r"([A-Za-z_$][\w$]*)\s*\(", head)
                if "=" in head.split("(")[0]:
                    fields(code[begin : m.start()], here)
                elif name and not re.search(r"\bnew\b", head):
                    opened = ("method", here, name[1], begin + (len(code[begin : m.start()]) - len(code[begin : m.start()].lstrip())), head[name.end() :])
            stack.append((depth, opened or ("block",)))
            begin, depth = m.end(), 0
        elif c == "}":
            if stack:
                depth, closed = stack.pop()
                if isinstance(closed, _Type):
                    closed.end = m.end()
                elif closed[0] == "method":
                    methods.append((closed[1], closed[2], closed[3], m.end(), closed[4]))
            begin = m.end()
    for _, left in stack:
        if isinstance(left, _Type):
            left.end = len(text)
        elif left[0] == "method":
            methods.append((left[1], left[2], left[3], len(text), left[4]))
    return package[1] if package else "", imports, types, methods


def _calls(body: str, parameters: str, of: _Type) -> list[tuple[str, str, str]]:
    """How, of and name of each call in a body: of the own class (own), the base (super), or a named type (type). Calls on what an expression yields have no sure type and are left out."""
    known: dict[str, str] = {}
    for t in reversed([t for t in _chain(of)]):
        known |= t.fields
    known |= _variables(_plain(parameters) + ")") | _variables(_plain(body))
    out = []
    for m in _CALL.finditer(body):
        before = body[: m.start()].rstrip()
        if m[2] in _NO_CALL or before.endswith((".", "::")) or re.search(r"\bnew$", before):
            continue
        chain = [x.strip() for x in m[1].split(".") if x.strip()]
        if chain[:1] == ["this"]:
            chain = chain[1:]
        if not chain:
            out.append(("own", "", m[2]))
        elif chain == ["super"]:
            out.append(("super", "", m[2]))
        elif len(chain) == 1 and chain[0] in known:
            out.append(("type", known[chain[0]], m[2]))
        elif chain[-1][:1].isupper():
            out.append(("type", ".".join(chain), m[2]))
    return out


def _chain(of: _Type | None) -> Iterator[_Type]:
    while of:
        yield of
        of = of.outer


def declarations(files: DataFrame) -> DataFrame:
    """A row for each type and each method of Java sources (path, text): package, type (its full name, nested ones after their outer types), outer, kind (type or method), form, name, bases as written, imports,
    first and last line, text, and a method's calls. Literals and comments open no braces; anonymous classes are part of the method that has them. Null texts have nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["text"]):
                text = text or ""
                package, imports, types, methods = outline(text)
                code = hidden(text)
                full = lambda t: ".".join([*filter(None, [package]), *reversed([x.name for x in _chain(t)])])  # noqa: B023, E731
                line = lambda at: text.count("\n", 0, at) + 1  # noqa: B023, E731
                for t in types:
                    at = t.at + len(text[t.at : t.end]) - len(text[t.at : t.end].lstrip())
                    out.append((path, package, full(t), full(t.outer) if t.outer else None, "type", t.form, t.name, t.bases, imports, line(at), line(t.end), None, []))
                for t, name, begin, end, parameters in methods:
                    begin += len(text[begin:end]) - len(text[begin:end].lstrip())
                    body = code[begin:end].partition("{")[2]
                    out.append((path, package, full(t), full(t.outer) if t.outer else None, "method", t.form, name, [], imports, line(begin), line(end), text[begin:end], [dict(zip(("how", "of", "name"), c)) for c in _calls(body, parameters, t)]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def call_graph(declared: DataFrame, deepest: int = 16) -> DataFrame:
    """source, target, n: methods (full type name and name) that call each other, and how often, from declarations().

    A written type is one of the same file or nested there, an import, one of the same package or of a package imported whole, or a full name; only types of these files count. A method belongs to the nearest type that has it,
    from the type itself over its bases, `deepest` at most, to its outer types. A call of a method that none of them has stays with a named type, as its callee can't be elsewhere in the project; others are left out.
    """
    work = Workspace(declared.sparkSession, "java")
    table = work.keep(declared, "declared")
    types = work.keep(table.where("kind = 'type'").select("path", "package", "type", "outer", "name", "bases", "imports"), "types")
    methods = table.where("kind = 'method'").select("path", "package", "type", "name", "calls", "imports")
    calls = methods.select("path", "package", "type", F.concat_ws(".", "type", "name").alias("source"), F.explode("calls").alias("c")).select("path", "package", "type", "source", "c.how", "c.of", "c.name").groupBy("path", "package", "type", "source", "how", "of", "name").agg(F.count("*").alias("n"))
    calls = work.keep(calls, "calls")
    base = types.select("path", "package", "type", F.explode("bases").alias("of"))
    written = calls.where("how = 'type'").select("path", "package", "of").union(base.select("path", "package", "of")).distinct()
    last = F.substring_index("of", ".", -1)
    known = types.select(F.col("type").alias("found")).distinct()
    imported = types.select("path", F.explode("imports").alias("i")).distinct()
    whole = imported.where(F.endswith("i", F.lit(".*"))).select("path", F.expr("substr(i, 1, length(i) - 2)").alias("p"))
    ways = [
        written.join(types.select("path", F.col("name").alias("of"), F.col("type").alias("found")), ["path", "of"]).select("path", "of", "found", F.lit(0).alias("way")),
        written.join(imported.select("path", F.col("i").alias("found"), F.substring_index("i", ".", -1).alias("of")), ["path", "of"]).select("path", "of", "found", F.lit(1).alias("way")),
        written.select("path", "of", F.when(F.col("package") == "", F.col("of")).otherwise(F.concat_ws(".", "package", "of")).alias("found"), F.lit(2).alias("way")),
        written.join(whole, "path").select("path", "of", F.concat_ws(".", "p", "of").alias("found"), F.lit(3).alias("way")),
        written.select("path", "of", F.col("of").alias("found"), F.lit(4).alias("way")),
        # Outer.Inner, where Outer is one of the ways above: by the written tail of a type's name in the same package or an import.
        written.where(last != F.col("of")).join(imported, "path").where(F.substring_index("i", ".", -1) == F.substring_index("of", ".", 1)).select("path", "of", F.concat(F.col("i"), F.expr("substr(of, instr(of, '.'))")).alias("found"), F.lit(5).alias("way")),
    ]
    every = ways[0]
    for w in ways[1:]:
        every = every.union(w)
    names = work.keep(every.join(known, "found").groupBy("path", "of").agg(F.min(F.struct("way", "found"))["found"].alias("found")), "names")
    up = base.join(names, ["path", "of"]).select("type", F.col("found").alias("base")).where("type <> base").distinct()
    # Each type with those that may hold its methods: itself, its bases step by step, then its outer types with theirs.
    above = work.keep(known.select(F.col("found").alias("type"), F.col("found").alias("at"), F.lit(0).alias("far")), "above0")
    edges = work.keep(up.select(F.col("type").alias("at"), F.col("base").alias("next"), F.lit(1).alias("more")).union(types.where("outer is not null").select(F.col("type").alias("at"), F.col("outer").alias("next"), F.lit(100).alias("more"))).distinct(), "edges")
    front, step = above, 0
    while step < deepest and front.limit(1).collect():
        step += 1
        reached = front.join(edges, "at").groupBy("type", F.col("next").alias("at")).agg(F.min(F.col("far") + F.col("more")).alias("far"))
        front = work.keep(reached.join(above.select("type", "at"), ["type", "at"], "left_anti"), f"front{step}")
        above = work.keep(above.unionByName(front), f"above{step}")
    own = calls.where("how = 'own'").withColumn("start", F.col("type"))
    of_base = calls.where("how = 'super'").join(up, "type").withColumn("start", F.col("base")).drop("base")
    named = calls.where("how = 'type'").join(names, ["path", "of"]).withColumnRenamed("found", "start")
    asked = own.unionByName(of_base).unionByName(named.select(own.columns)).select("source", "how", "start", "name", "n")
    held = methods.select(F.col("type").alias("at"), "name").distinct()
    nearest = asked.select("start", "name").distinct().join(above.withColumnRenamed("type", "start"), "start").join(held, ["at", "name"]).groupBy("start", "name").agg(F.min(F.struct("far", "at"))["at"].alias("owner"))
    to = asked.join(nearest, ["start", "name"], "left").withColumn("owner", F.coalesce("owner", F.when(F.col("how") == "type", F.col("start")))).where("owner is not null")
    return to.groupBy("source", F.concat_ws(".", "owner", "name").alias("target")).agg(F.sum("n").alias("n")).where("source <> target")
