"""Entities and references of source files.  Python goes through its own parser; other languages,
and Python that does not parse, through line patterns."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import stores

#: Line patterns by language: (kind, pattern with a group for the name) (fixed values).
_C_LIKE = [("class", r"^\s*(?:(?:public|private|protected|internal|abstract|final|static|sealed|partial|data|open|case|export|default)\s+)*(?:class|interface|struct|enum|record|trait|object|protocol|extension)\s+(\w+)")]
_METHOD = [("function", r"^\s*(?:(?:public|private|protected|internal|static|final|virtual|override|async|abstract|inline|const|synchronized|extern|unsigned|signed|struct|long|short)\s+)*[\w.:]+(?:<[^(){};=]*>)?[\[\]?*&]*\s+[*&]*(\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:throws [\w, .]+)?\{")]
LEXICAL = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"C\"\s+)*fn\s+(\w+)")],
    "typescript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)")],
    "java": _C_LIKE + _METHOD, "csharp": _C_LIKE + _METHOD, "c": _C_LIKE + _METHOD, "cpp": _C_LIKE + _METHOD,
    "php": _C_LIKE + [("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)")],
    "ruby": [("class", r"^\s*(?:class|module)\s+([\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)")],
    "kotlin": _C_LIKE + [("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)")],
    "swift": _C_LIKE + [("function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*(init)\s*[?(]")],
    "scala": _C_LIKE + [("function", r"^\s*(?:\w+\s+)*def\s+(\w+)")],
    "bash": [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+([\w-]+)")],
}
LEXICAL["javascript"] = LEXICAL["typescript"]
IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^\s*import\s+([\w.]+)",
    "scala": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "csharp": r"^\s*using\s+([\w.]+)\s*;", "php": r"^\s*use\s+([\w\\]+)", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)",
    "c": r"^\s*#\s*include\s+[<\"]([^>\"]+)", "cpp": r"^\s*#\s*include\s+[<\"]([^>\"]+)", "bash": r"^\s*(?:source|\.)\s+(\S+)", "typescript": r"^\s*import\s.*?from\s+['\"]([^'\"]+)", "javascript": r"^\s*import\s.*?from\s+['\"]([^'\"]+)",
}
_EXTENDS = re.compile(r"\bclass\s+(\w+)\s*(?:<[^>]*>)?\s*(?:\(([^)]*)\)|(?:extends|:|<)\s*([\w., ]+))")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "def", "func", "fun", "and", "or", "not", "in", "elif", "sizeof", "when", "with", "new", "super", "self", "foreach", "class", "init"}
#: Words that begin blocks and are no names (fixed values).
_RESERVED = {"if", "for", "while", "switch", "match", "return", "catch", "else", "do", "try", "elif", "when", "with", "foreach", "sizeof"}
_JSX = re.compile(r"<([A-Z]\w*)[\s/>]")

def _python(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    tree = ast.parse(text)
    entities, deps = [], []

    def signature(f) -> tuple[list[tuple], str | None]:
        a = f.args
        names = [*a.posonlyargs, *a.args]
        params = [(x.arg, ast.unparse(x.annotation) if x.annotation else None) for x in names if x.arg not in ("self", "cls")]
        if a.vararg:
            params.append(("*" + a.vararg.arg, None))
        params += [(x.arg, ast.unparse(x.annotation) if x.annotation else None) for x in a.kwonlyargs]
        if a.kwarg:
            params.append(("**" + a.kwarg.arg, None))
        return params, ast.unparse(f.returns) if f.returns else None

    def calls(node, caller: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    deps.append(("invokes", caller, name, None))

    def visit(body, parent: str | None) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                entities.append(("class", x.name, x.lineno, x.end_lineno, parent, None))
                for b in x.bases:
                    deps.append(("inherits", x.name, ast.unparse(b).split(".")[-1], None))
                visit(x.body, x.name)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                entities.append(("method" if parent else "function", x.name, x.lineno, x.end_lineno, parent, signature(x)))
                calls(x, f"{parent}.{x.name}" if parent else x.name)
            elif isinstance(x, (ast.If, ast.Try)):
                visit(x.body, parent)

    for x in tree.body:
        if isinstance(x, ast.Import):
            deps += [("imports", "", a.name.split(".")[-1], a.name) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            deps += [("imports", "", a.name, x.module or "") for a in x.names]
    visit(tree.body, None)
    return entities, deps


#: Comments and literals by language (fixed values).
_HASHED = re.compile(r"""#[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", re.DOTALL)
_SLASHED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.DOTALL)
_RUST = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\[^']+|[^'\\\n])'""", re.DOTALL)
LITERALS = {"ruby": _HASHED, "bash": _HASHED, "python": _HASHED, "rust": _RUST}


def blanked(text: str, language: str) -> str:
    """A source with spaces for its comments and the insides of its literals, line by line as before."""
    return LITERALS.get(language, _SLASHED).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def header(lines: list[str], i: int, most: int = 40) -> str:
    """A declaration from line ``i`` on as one line: as far as its parentheses go, and a brace below them."""
    if "(" not in lines[i]:
        return lines[i]
    out, depth, k = lines[i], lines[i].count("(") - lines[i].count(")"), i
    while depth > 0 and k + 1 < len(lines) and k < i + most:
        k += 1
        out += " " + lines[k].strip()
        depth += lines[k].count("(") - lines[k].count(")")
    if k + 1 < len(lines) and lines[k + 1].strip() == "{":
        out += " {"
    return out


def _pieces(text: str) -> list[str]:
    """The parts between commas that no bracket holds."""
    out, depth, part = [], 0, ""
    for before, c in zip(" " + text, text, strict=False):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and before not in "-="))
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


def _inside(text: str, at: int) -> tuple[str, str]:
    """What stands in the parentheses that open at ``at``, and after them."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return text[at + 1 : k], text[k + 1 :]
    return text[at + 1 :], ""


#: How languages write parameters and results (fixed values): type after the name and a colon, type before
#: the name, name and type without a sign, names alone; and the sign before a result.
_COLON, _BEFORE, _AFTER, _BARE = {"rust", "typescript", "javascript", "kotlin", "scala", "swift"}, {"java", "csharp", "c", "cpp", "php"}, {"go"}, {"ruby"}
_RESULT = {"rust": r"\s*->\s*([^{;]+?)\s*(?:where\b.*)?(?:[{;]|$)", "swift": r"\s*(?:async\s*)?(?:throws\s*)?->\s*([^{]+?)\s*(?:[{]|$)", "go": r"\s*([^{]+?)\s*(?:[{]|$)"}
_RESULT |= dict.fromkeys(("typescript", "javascript"), r"\s*:\s*(.+?)\s*(?:[{]|=>|$)") | dict.fromkeys(("kotlin", "scala", "php"), r"\s*:\s*([^={;]+?)\s*(?:[={;]|$)")
_MODIFIERS = {"public", "private", "protected", "internal", "static", "final", "virtual", "override", "async", "abstract", "inline", "const", "synchronized", "extern", "unsafe", "native", "sealed", "partial", "default", "explicit", "friend", "constexpr", "volatile"}
_RECEIVERS = re.compile(r"^(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?self\b")


def signature_of(language: str, head: str, name: str) -> tuple[list[tuple], str | None] | None:
    """(parameters (name, type), result type) of a declaration by its header; receivers are no
    parameters, ``void`` and ``()`` no results.  None where the language writes none."""
    m = re.search(rf"(?<!\w){re.escape(name)}\s*(?:<[^()]*>)?\s*(?:=\s*(?:async\s*)?(?:function\s*)?)?(?::[^=()]*=\s*)?\(", head)
    if language == "bash" or not m and language != "ruby":
        return None
    inside, after = _inside(head, m.end() - 1) if m else ("", "")
    params: list[tuple] = []
    for part in _pieces(inside):
        part = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s+|\[[^\]]*\]\s*)+", "", part)
        part = re.split(r"(?<![=<>!])=(?!=|>)", part)[0].strip()
        if language in _COLON:
            if language == "rust" and _RECEIVERS.match(part):
                continue
            left, _, kind = part.partition(":")
            words = re.findall(r"\.{0,3}\w+", left)
            if words:
                params.append((words[-1], kind.strip() or None))
        elif language in _BEFORE:
            mine = re.match(r"^(.*?)([&*.]*)\$?(\w+)\s*((?:\[\w*\])*)$", part)
            if mine and part != "void":
                kind = f"{mine[1].strip()}{mine[2]}{mine[4]}".strip()
                kind = " ".join(w for w in kind.split() if w != "final")
                params.append((mine[3], kind or None) if kind or language == "php" else ("", mine[3]))
        elif language in _AFTER:
            first, _, kind = part.partition(" ")
            params.append((first, kind.strip() or None))
        else:
            params.append((re.split(r"[:\s]", part.lstrip("*&"))[0], None))
    if language in _AFTER:  # a type stands for the names before it, and alone if no name has one
        if any(k for _, k in params):
            for i in reversed(range(len(params) - 1)):
                params[i] = (params[i][0], params[i][1] or params[i + 1][1])
        else:
            params = [("", n) for n, _ in params]
    if language in _RESULT:
        r = re.match(_RESULT[language], after)
        result = r[1].strip() if r else None
    elif language in _BEFORE:
        words = [w for w in head[: m.start()].split() if w not in _MODIFIERS]
        result = " ".join(words).strip() or None
    else:
        result = None
    return params, None if result in ("void", "()", "Unit", "Void", "") else result


def _end(lines: list[str], i: int, language: str) -> int:
    """The last line of a block that begins at line ``i``: by braces, ``end`` or indentation."""
    if language in ("python",):
        indent = len(lines[i]) - len(lines[i].lstrip())
        last = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                last = j
        return last
    if language == "ruby":
        indent = len(lines[i]) - len(lines[i].lstrip())
        return next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "end" and len(lines[j]) - len(lines[j].lstrip()) == indent), i)
    depth, seen, round_ = 0, False, 0
    for j in range(i, len(lines)):
        depth += lines[j].count("{") - lines[j].count("}")
        round_ += lines[j].count("(") - lines[j].count(")")
        seen = seen or "{" in lines[j]
        if seen and depth <= 0:
            return j
        if not seen and round_ <= 0 and j > i + 2:
            return i
    return i if not seen else len(lines) - 1


def _lexical(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    whole, lines = text.split("\n"), blanked(text, language).split("\n")
    found, deps = [], []
    patterns = [(k, re.compile(p)) for k, p in LEXICAL.get(language, [])]
    for i, line in enumerate(lines):
        head = header(lines, i) if line.strip() else line
        for kind, p in patterns:
            m = p.match(head)
            if m and m[1] not in _RESERVED:
                sig = signature_of(language, head, m[1]) if kind == "function" else None
                found.append((kind, m[1], i, _end(lines, i, language), sig))
                break
        m = re.match(IMPORTS[language], whole[i]) if language in IMPORTS and line.strip() else None
        if m:
            deps.append(("imports", "", re.split(r"[:./\\]+", m[1].rstrip(";"))[-1], m[1]))
        m = _EXTENDS.search(line)
        if m and language != "go":
            for base in re.split(r",\s*|\s+with\s+|\s+implements\s+", m[2] or m[3] or ""):
                if base.strip() and "=" not in base:
                    deps.append(("inherits", m[1], base.strip().split(".")[-1], None))
    classes = [(n, a, b) for k, n, a, b, _ in found if k == "class"]
    impls = [(m[1], i, _end(lines, i, language)) for i, line in enumerate(lines) if (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", line))] if language == "rust" else []
    entities = []
    for kind, name, a, b, sig in found:
        inside = [(c, x, y) for c, x, y in classes + impls if x < a <= y]
        parent = min(inside, key=lambda c: c[2] - c[1])[0] if inside and kind == "function" else None
        kind = "method" if parent else kind
        if language in ("typescript", "javascript"):
            kind = frontend_kind(path, kind, name, "\n".join(whole[a : b + 1]))
        entities.append((kind, name, a + 1, b + 1, parent, sig))
    scopes = [(f"{p}.{n}" if p else n, a, b) for k, n, a, b, p, _ in entities if k != "class"]
    for i, line in enumerate(lines, 1):
        own = enclosing(scopes, i)
        if own and i != next(a for n, a, b in scopes if (n, a, b) == own):
            deps += [("invokes", own[0], c, None) for c in _CALL.findall(line) if c not in _NOT_CALLS]
            if path.endswith(("x",)):
                deps += [("renders", own[0], c, None) for c in _JSX.findall(line)]
    if language in ("typescript", "javascript"):
        code = "\n".join(lines)
        for kind, row, target in stores.signals(text, code):
            own = enclosing(scopes, row)
            deps.append((kind, own[0] if own else "<module>", target, None))
        entities += stores.entities(code)
    return entities, deps


def frontend_kind(path: str, kind: str, name: str, source: str) -> str:
    """Pages, layouts, hooks, components and stores by their names and places."""
    if kind != "function":
        return kind
    if re.search(r"(^|/)app/(.*/)?page\.[jt]sx?$", path):
        return "page"
    if re.search(r"(^|/)app/(.*/)?layout\.[jt]sx?$", path):
        return "layout"
    if re.match(r"use[A-Z]", name):
        return "hook"
    if name[:1].isupper() and _JSX.search(source) or name[:1].isupper() and re.search(r"return\s*\(?\s*<", source):
        return "component"
    return "store" if re.search(r"\b(createSlice|configureStore|createStore)\s*\(", source) else kind


def enclosing(scopes: list[tuple[str, int, int]], row: int) -> tuple[str, int, int] | None:
    """The shortest scope (name, first, last) that holds a row, ends included."""
    return min((s for s in scopes if s[1] <= row <= s[2]), key=lambda s: s[2] - s[1], default=None)


def parse(path: str, language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    if language == "python":
        try:
            return _python(path, text)
        except (SyntaxError, ValueError):
            pass
    return _lexical(path, text, language)


def entity_id(path: str, name: str, parent: str | None) -> str:
    return f"{path}:{parent}::{name}" if parent else f"{path}:{name}"


_ENTITY = (
    "id string, kind string, name string, file string, line_start int, line_end int, parent_class string,"
    " signature struct<parameters: array<struct<name: string, type_annotation: string>>, return_type: string>"
)
_REFERENCE = "file string, kind string, caller string, callee string, module string"


def _rows(path: str, language: str, text: str) -> tuple[list[dict], list[dict]]:
    """A file's entities, of equal ids the last, and its references."""
    entities, references = {}, []
    found, deps = parse(path, language, text)
    for kind, name, a, b, parent, sig in found:
        s = {"parameters": [{"name": n, "type_annotation": t} for n, t in sig[0]], "return_type": sig[1]} if sig else None
        i = entity_id(path, name, parent)
        entities[i] = {"id": i, "kind": kind, "name": name, "file": path, "line_start": a, "line_end": b, "parent_class": parent, "signature": s}
    for kind, caller, callee, module in deps:
        references.append({"file": path, "kind": kind, "caller": caller, "callee": callee, "module": module})
    return list(entities.values()), references


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, references) of (path, language, content): each file is parsed once, and what was found
    is kept in the shared folder.  Null content is empty; unknown languages have none of either."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [_rows(p, lang, text or "") for p, lang, text in zip(f["path"], f["language"], f["content"], strict=True)]
            yield pd.DataFrame({"e": [e for e, _ in both], "r": [r for _, r in both]})

    found = cut(files.select("path", "language", "content").mapInPandas(run, f"e array<struct<{_ENTITY}>>, r array<struct<{_REFERENCE}>>"))
    return found.select(F.inline("e")), found.select(F.inline("r"))


def extract_entities(files: DataFrame) -> DataFrame:
    """(id, kind, name, file, line_start, line_end, parent_class, signature) of (path, language, content);
    of equal ids the last wins."""
    return extract(files)[0]


def extract_references(files: DataFrame) -> DataFrame:
    """(file, kind, caller, callee, module) of (path, language, content)."""
    return extract(files)[1]


def enclosing_scopes(calls: DataFrame, scopes: DataFrame, block: int = 256) -> DataFrame:
    """The interval join: (file, row) with the shortest scope (file, scope, first, last) that holds it.
    Rows meet only scopes that touch their block of lines, so that a file of many scopes and calls
    does not give the product of both."""
    lines = F.sequence((F.col("first") / block).cast("long"), (F.greatest("first", "last") / block).cast("long"))
    dealt = scopes.select("*", F.explode(lines).alias("_block"))
    rows = calls.withColumn("_block", (F.col("row") / block).cast("long")).join(dealt, ["file", "_block"]).filter("row BETWEEN first AND last")
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("n"), "scope"))
    return rows.groupBy("file", "row").agg(best.alias("m")).select("file", "row", "m.scope")


def has_dependency(content: Column, name: str) -> Column:
    """Whether a manifest names a dependency: in quotes, or as a word of its own before white space or a
    version."""
    word = r"(?:^|\s)" + re.escape(name) + r"(?=[\s=><~!;@]|$)"
    return F.contains(content, F.lit(f'"{name}"')) | F.contains(content, F.lit(f"'{name}'")) | content.rlike(word)


def detect_paradigms(files: DataFrame, rules: list[dict]) -> list[str]:
    """Names of the rules that fit a tree, by priority: a manifest's dependency, a file's name, a
    file glob, or a glob of names in a folder, and a language of the rule's; a rule without any of the
    former, or without languages, does not ask for them.  One row of flags comes to the driver."""
    from ..functions.text import glob_regex

    if not rules:
        return []
    manifest = F.col("path").rlike(r"(^|/)(package\.json|requirements\.txt|pyproject\.toml|setup\.py|Cargo\.toml|go\.mod|pom\.xml|Gemfile|composer\.json|Package\.swift|build\.gradle(\.kts)?|[^/]+\.csproj)$")
    flags = []
    for r in rules:
        hit = F.lit(not any(r.get(k) for k in ("deps", "configs", "globs", "dirs")))
        for d in r.get("deps", []):
            hit = hit | (manifest & has_dependency(F.coalesce("content", F.lit("")), d))
        for n in r.get("configs", []):
            hit = hit | F.col("path").rlike(f"(^|/){re.escape(n)}$")
        for g in r.get("globs", []):
            hit = hit | F.col("path").rlike(glob_regex(g))
        for folder, pattern in r.get("dirs", []):
            inside = glob_regex(pattern).removeprefix("(?s)^").removesuffix("$").replace(".*", "[^/]*")
            hit = hit | F.col("path").rlike(f"(^|/){re.escape(folder.strip('/'))}/(.*/)?{inside}$")
        speaks = F.coalesce(F.col("language").isin(r["languages"]), F.lit(False)) if r["languages"] else F.lit(True)
        flags.append((F.bool_or(hit) & F.bool_or(speaks)).alias(r["name"]))
    row = files.agg(*flags).first()
    return [r["name"] for r in sorted(rules, key=lambda r: r.get("priority", 100)) if row[r["name"]]]
