"""Stores in TypeScript and JavaScript: entities that store libraries make by calls, and functions that
read, write or dispatch state.  All positions are those of a source with blanked comments and literals."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

#: Calls that make an entity, and its kind; hooks and names that touch state (fixed values).
MADE = {"configureStore": "store", "createStore": "store", "createSlice": "store", "createApi": "store", "createAsyncThunk": "function"}
READERS = {"useSelector", "useAppSelector", "useStore", "getState", "useAtomValue"}
SELECTORS, DISPATCHERS = {"useSelector", "useAppSelector"}, {"useDispatch", "useAppDispatch"}
NO_SETTERS = {"setTimeout", "setInterval", "setImmediate", "setPrototypeOf"}
BINDINGS = "react-redux"

_BRACKET = re.compile(r"[(\[{}\])]")
_NAME = r"[A-Za-z_$][\w$]*"
_MAKES = re.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*({'|'.join(MADE)})\s*(?:<[^()]*>)?\s*\(")
_HOOKS = re.compile(rf"\b(?:const|let|var)\s*\{{([^{{}}]*)\}}\s*=\s*{_NAME}\s*(?=[;\n]|$)")
_KEY = re.compile(rf"\s*(?:async\s+)?({_NAME})\s*[:(]")
_CALLED = re.compile(rf"(?<![\w$])({_NAME})\s*(?:<[^<>()]*>)?\s*\(")
_ARGUMENT = re.compile(rf"\s*(?:{_NAME}\s*\.\s*)*({_NAME})\s*([(,)])")
_BOUND = re.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(?:{_NAME}\s*\.\s*)*({_NAME})\s*(?:<[^<>()]*>)?\s*\(")


def closing(code: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes; the end if it doesn't."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.start()
    return len(code)


def items(code: str, at: int) -> Iterator[tuple[int, int]]:
    """The spans between the commas of the bracket that opens at ``at``."""
    begin, end, k = at + 1, closing(code, at), at + 1
    while k < end:
        if code[k] in "([{":
            k = closing(code, k)
        elif code[k] == ",":
            yield begin, k
            begin = k + 1
        k += 1
    if code[begin:end].strip():
        yield begin, end


def liner(code: str) -> Callable[[int], int]:
    """From a position to its line."""
    ends = [m.start() for m in re.finditer("\n", code)]
    return lambda at: bisect_left(ends, at) + 1


def entities(code: str) -> list[tuple]:
    """(kind, name, first line, last line, parent, None): stores, slices, interfaces and thunks, the
    reducers of a slice as its children, and hooks taken out of an interface by name."""
    line, out = liner(code), []
    for m in _MAKES.finditer(code):
        opened = m.end() - 1
        out.append((MADE[m[2]], m[1], line(m.start()), line(closing(code, opened)), None, None))
        settings = next(items(code, opened), None) if m[2] == "createSlice" else None
        brace = code.find("{", *settings) if settings else -1
        for a, b in items(code, brace) if brace >= 0 else ():
            r = re.match(r"\s*reducers\s*:\s*(?=\{)", code[a:b])
            for x, y in items(code, a + r.end()) if r else ():
                key = _KEY.match(code, x, y)
                if key:
                    out.append(("function", key[1], line(key.start(1)), line(y - 1), m[1], None))
    for m in _HOOKS.finditer(code):
        for part in m[1].split(","):
            name = part.split(":")[-1].split("=")[0].strip()
            if re.match(r"use[A-Z]", name):
                out.append(("hook", name, line(m.start()), line(m.end()), None, None))
    return out


def aliases(text: str) -> tuple[set[str], set[str]]:
    """Local names of the hooks that select and that dispatch, as imported from the bindings."""
    select, send = set(SELECTORS), set(DISPATCHERS)
    for m in re.finditer(r"\bimport\b[^;{}]*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]", text):
        for spec in m[1].split(",") if m[2] == BINDINGS else ():
            name, _, local = (x.strip() for x in spec.strip().partition(" as "))
            if name in SELECTORS:
                select.add(local or name)
            if name in DISPATCHERS:
                send.add(local or name)
    return select, send


def reads(name: str) -> bool:
    return name in READERS or re.match(r"use[A-Z]\w*(?:Query|Mutation)$", name) is not None


def writes(name: str) -> bool:
    return name == "setState" or (name not in NO_SETTERS and re.match(r"set[A-Z]", name) is not None)


def signals(text: str, code: str) -> Iterator[tuple[str, int, str]]:
    """(edge kind, line, target) of calls that touch state.  A selector's argument is read too, a setter of
    a Store or Slice writes the store of its name, and what is dispatched is the argument's last name."""
    select, send = aliases(text)
    senders, line = {"dispatch"} | {m[1] for m in _BOUND.finditer(code) if m[2] in send}, liner(code)
    for m in _CALLED.finditer(code):
        name, opened = m[1], m.end() - 1
        touched = name in select or reads(name) or writes(name) or name in senders
        if not touched or re.search(r"\bfunction\s*\*?\s*$", code[max(0, m.start() - 20) : m.start()]) or re.match(r"\s*(?::[^;{}=]*)?\{", code[(end := closing(code, opened) + 1) : end + 200]):
            continue
        at, argument = line(m.start()), _ARGUMENT.match(code, opened + 1)
        if name in select or reads(name):
            yield "reads_state", at, name
            if name in select and argument and argument[2] != "(":
                yield "reads_state", at, argument[1]
        if writes(name):
            yield "writes_state", at, name
            if name.endswith(("Store", "Slice")):
                yield "writes_state", at, name[3].lower() + name[4:]
        if name in senders:
            yield "dispatches", at, argument[1] if argument else "dispatch"
