"""A reader for EDN, the notation of configurations and schemas.

Maps and vectors become dicts and lists, sets frozensets, keywords ``Keyword``
(a string without the colon), symbols ``Symbol``; tagged elements go through ``tags``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass


class Keyword(str):
    """A keyword, without its colon; ``namespace`` and ``name`` are its parts."""

    __slots__ = ()

    @property
    def namespace(self) -> str:
        return self.rpartition("/")[0]

    @property
    def name(self) -> str:
        return self.rpartition("/")[2]

    def __repr__(self) -> str:
        return f":{str(self)}"


class Symbol(str):
    __slots__ = ()


@dataclass(frozen=True)
class Glob:
    """Files of a folder whose names match a pattern; found when the plan is made."""

    folder: str
    pattern: str


class EdnError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<skip>[\s,]+|;[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<char>\\(?:newline|space|tab|return|u[0-9A-Fa-f]{4}|.))"""
    r"""|(?P<open>\#:[\w.+-]+\{|\#\{|\(|\[|\{)|(?P<close>[\)\]\}])|(?P<discard>\#_)|(?P<tag>\#[A-Za-z][\w./+-]*)|(?P<atom>[^\s,;"\\(){}\[\]]+)""",
    re.DOTALL,
)
_CLOSES = {"(": ")", "[": "]", "{": "}", "#{": "}"}
_NUMBER = re.compile(r"[+-]?(\d+)(N)?$|[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?$")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}

TAGS: dict[str, Callable[[object], object]] = {"glob": lambda v: Glob(*v), "inst": lambda v: v, "uuid": lambda v: v}


def _string(raw: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), raw[1:-1])


def _atom(raw: str) -> object:
    if raw[0] == ":" and len(raw) > 1:
        return Keyword(raw[1:])
    if raw in ("true", "false"):
        return raw == "true"
    if raw == "nil":
        return None
    if m := _NUMBER.match(raw):
        return int(raw.rstrip("N")) if m[1] is not None else float(raw.rstrip("M"))
    return Symbol(raw)


def read_all(text: str, tags: Mapping[str, Callable[[object], object]] = TAGS) -> list[object]:
    """Every form of a text."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    pending: list[tuple[int, str]] = []  # tags and discards wait, by depth, for the next form

    def put(value: object) -> None:
        while pending and pending[-1][0] == len(stack):
            _, tag = pending.pop()
            if tag == "#_":
                return
            if tag not in tags:
                raise EdnError(f"unknown tag #{tag}")
            value = tags[tag](value)
        stack[-1][1].append(value)

    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EdnError(f"line {text.count(chr(10), 0, at) + 1}: a string or character doesn't end")
        at, kind, raw = m.end(), m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "open":
            stack.append((raw, []))
        elif kind == "close":
            opened, items = stack.pop() if len(stack) > 1 else ("", [])
            if _CLOSES.get(opened, "}" if opened.startswith("#:") else None) != raw:
                raise EdnError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {raw}")
            if opened == "{" or opened.startswith("#:"):
                if len(items) % 2:
                    raise EdnError(f"line {text.count(chr(10), 0, at) + 1}: a map with a key and no value")
                space = opened[2:-1] + "/" if opened.startswith("#:") else ""  # a namespace for the map's plain keywords
                keys = [Keyword(space + k) if space and isinstance(k, Keyword) and "/" not in k else k for k in items[::2]]
                put(dict(zip(keys, items[1::2], strict=True)))
            else:
                put(frozenset(items) if opened == "#{" else items)
        elif kind in ("discard", "tag"):
            pending.append((len(stack), "#_" if kind == "discard" else raw[1:]))
        else:
            put(_string(raw) if kind == "string" else _CHARS.get(raw[1:], chr(int(raw[2:], 16)) if len(raw) == 6 else raw[1:]) if kind == "char" else _atom(raw))
    if len(stack) > 1:
        raise EdnError(f"the file ends inside {stack[-1][0]}: a bracket is not closed")
    return root


def read(text: str) -> object:
    """The first form of a text."""
    forms = read_all(text)
    if not forms:
        raise EdnError("the file holds nothing")
    return forms[0]


def write(value: object) -> str:
    """Text that ``read`` gives back: dicts, lists, frozensets, keywords, symbols and plain values."""
    if value is None or isinstance(value, bool):
        return {None: "nil", True: "true", False: "false"}[value]
    if isinstance(value, Keyword):
        return f":{str(value)}"
    if isinstance(value, Symbol):
        return str(value)
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    if isinstance(value, Mapping):
        return "{" + " ".join(f"{write(k)} {write(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (set, frozenset)):
        return "#{" + " ".join(sorted(map(write, value))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(write, value)) + "]"
    return repr(value)


def read_file(path: str) -> object:
    with open(path, encoding="utf-8") as file:
        try:
            return read(file.read())
        except EdnError as error:
            raise EdnError(f"{path}: {error}") from None
