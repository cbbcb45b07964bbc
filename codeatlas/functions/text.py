"""Column functions over text: globs, tokens, similarities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str | None:
    """A regular expression for a glob in which ``*`` crosses ``/``; None if its brackets or
    braces don't match."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}":
            depth, out = depth - 1, out + ")"
            if depth < 0:
                return None
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return None if depth else f"(?s)^{out}$"


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def normalised_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def drift(old: Column, new: Column) -> Column:
    """Jaccard distance; two empty sets have 0."""
    return F.when((F.size(old) == 0) & (F.size(new) == 0), F.lit(0.0)).otherwise(1 - jaccard(old, new))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def clean_score(x: Column) -> Column:
    """Six decimals, half away from zero; NaN, infinities and -0 become 0."""
    bad = F.isnan(x) | F.abs(x).isin(float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.round(x, 6) + F.lit(0.0))


def split_words(name: Column) -> Column:
    """Words of a camel-case, snake-case or acronym name, lower-case, single spaces."""
    apart = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(apart, r"[_\-\s]+", " ")))


#: Patterns of the structural counters (fixed values).
BRANCHES = r"\b(if|else|match|switch|case|when|elif|elsif)\b"
LOOPS = r"\b(for|while|loop|each)\b"
CALLS = r"\b[a-zA-Z_]\w*\s*\("


def structural_signals(source: Column) -> dict[str, Column]:
    """Counts of branches, loops, early returns (lines with a return but the last line that has text),
    calls and lines; an end of line at the end begins no line."""
    lines = F.filter(F.split(F.regexp_replace(source, "\n$", ""), "\n"), lambda x: source != "")
    body = F.regexp_replace(source, r"\s+$", "")
    before_last = F.when(F.instr(body, "\n") > 0, F.regexp_replace(body, r"\n[^\n]*$", "")).otherwise(F.lit(""))
    count = lambda s, p: F.regexp_count(s, F.lit(p)).cast("long")
    return {
        "branches": count(source, BRANCHES),
        "loops": count(source, LOOPS),
        "early_returns": F.size(F.filter(F.split(before_last, "\n"), lambda x: x.rlike(r"\breturn\b"))).cast("long"),
        "calls": count(source, CALLS),
        "lines": F.size(lines).cast("long"),
    }
