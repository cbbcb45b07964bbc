"""Tokens of source code for clones that differ in names and literals only."""

from __future__ import annotations

import re
import zlib

#: Keywords of the languages (fixed values).
KEYWORDS = frozenset(
    """fn let mut const static pub mod use crate self Self super struct enum impl trait type where async await move ref match if else loop
    while for in return break continue unsafe extern dyn as
    function var class interface extends implements import export from default new this typeof instanceof void null undefined true false
    try catch finally throw switch case do delete yield constructor readonly
    def lambda pass raise except with assert global nonlocal print elif
    package go chan select defer fallthrough goto range map make append copy
    public private protected final abstract synchronized volatile transient native strictfp throws
    int char float double long short unsigned signed auto register inline restrict sizeof typedef""".split()
)
_TOKEN = re.compile(
    r"""//[^\n]*|/\*(?:.*?\*/|.*)
    |(?P<literal>"(?:[^"\\]|\\.?)*(?:"|$)|'(?:[^'\\]|\\.?)*(?:'|$)|[0-9][0-9.xXeE]*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<sign>[<>=!&|+\-*/%^][=&|<>+]?|[{}()\[\];:,.\#@~?])""",
    re.VERBOSE | re.DOTALL,
)


def code_tokens(text: str | None) -> list[int]:
    """Numbers of a source's tokens: comments and white space are none, all literals are one token and all
    names another, keywords, operators and punctuation are themselves; other characters are skipped."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        word = m["word"]
        name = "LIT" if m["literal"] is not None else word if word in KEYWORDS else "ID" if word is not None else m["sign"]
        if name is not None:
            out.append(zlib.crc32(name.encode()) & 0x7FFFFFFF)
    return out
