"""From a search query to what an index can tell about its matches.

A regular expression is planned as alternatives, each a set of three-character sequences that
every text matching it must have. The plan is sound: a literal too short for a sequence asks
for nothing, and so does whatever may be left out. An alternative that asks for nothing
admits every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as P

META = set(".^$*+?{}[]\\|()")
FLAGS = {"i": re.I, "m": re.M, "s": re.S, "x": re.X}


@dataclass
class Plan:
    """A parsed query: ``alternatives`` is None where nothing can be asked of an index."""

    pattern: str
    is_regex: bool
    flags: int = 0
    valid: bool = True
    alternatives: list[frozenset[str]] | None = field(default=None)

    def java(self) -> str:
        """The pattern with its flags for the JVM, where its classes and word boundaries mean all of Unicode as well."""
        letters = "".join(k for k, v in FLAGS.items() if self.flags & v)
        return f"(?U{letters})" + (for_java(self.pattern) or "a^")


_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?\(|.", re.S)


def for_java(pattern: str) -> str | None:
    """``pattern`` as the JVM writes it: named groups, the end of the text; None if it holds what the JVM can't do."""
    out, names = "", {}
    for m in _TOKEN.finditer(pattern):
        sign = m[0]
        if m[1]:
            names[m[1]] = f"g{len(names) + 1}"
            sign = f"(?<{names[m[1]]}>"
        elif m[2]:
            if m[2] not in names:
                return None
            sign = rf"\k<{names[m[2]]}>"
        elif sign == "(?(":
            return None
        elif sign == r"\Z":
            sign = r"\z"
        elif sign[0] == "[" and len(sign) > 1:  # signs that mean something else within the JVM's classes
            inner = sign[1:-1]
            sign = "[" + re.sub(r"\\.|(?<!^)\[|^\[|&&", lambda x: x[0] if x[0][0] == "\\" else "".join("\\" + c for c in x[0]), inner) + "]"
            sign = re.sub(r"^\[(\^?)\]", r"[\1\\]", sign)
        out += sign
    return out


def parse(query: str) -> tuple[bool, str, int]:
    """(is a regular expression, pattern, flags): written between slashes, or with any of its signs."""
    text = query.strip()
    slashed = re.fullmatch(r"/(.*)(?<!\\)/([^/]*)", text, re.S) if text[:1] == "/" else None
    if slashed:
        flags = 0
        for letter in slashed[2].lower():
            flags |= FLAGS.get(letter, 0)
        return True, slashed[1], flags
    return bool(META & set(text)), text, 0


def sequences(literal: str) -> frozenset[str]:
    """Three-character sequences of a literal as an index holds them: lower case, white space collapsed."""
    flat = re.sub(r"\s+", " ", literal.lower()).strip()
    return frozenset(flat[i : i + 3] for i in range(len(flat) - 2))


def plan(query: str, alternatives: int = 64, each: int = 32) -> Plan:
    """The plan of a query; at most ``alternatives`` of at most ``each`` sequences, beyond which it asks for less."""
    is_regex, pattern, flags = parse(query)
    if not is_regex:
        return Plan(pattern, False)
    try:
        tree = P.parse(pattern, flags)
    except (re.error, RecursionError, OverflowError):
        return Plan(pattern, True, flags, valid=False)
    if for_java(pattern) is None:
        return Plan(pattern, True, flags, valid=False)
    if tree.state.flags & re.X:
        return Plan(pattern, True, flags)

    def crossed(left: list[frozenset], right: list[frozenset]) -> list[frozenset]:
        out = list(dict.fromkeys(a | b for a in left for b in right))
        return out if len(out) <= alternatives else [frozenset()]

    def walk(items) -> list[frozenset]:
        found, literal = [frozenset()], ""

        def close() -> None:
            nonlocal found, literal
            found, literal = crossed(found, [sequences(literal)]), ""

        for op, arg in items:
            if op is C.LITERAL:
                literal += chr(arg)
                continue
            close()
            if op is C.SUBPATTERN:
                found = crossed(found, walk(arg[3]))
            elif op is C.BRANCH:
                options = [x for branch in arg[1] for x in walk(branch)]
                found = crossed(found, list(dict.fromkeys(options)))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                found = crossed(found, walk(arg[2]))
            elif op is C.ATOMIC_GROUP:
                found = crossed(found, walk(arg))
        close()
        return found

    found = walk(tree)
    if any(not x for x in found):
        return Plan(pattern, True, flags)
    return Plan(pattern, True, flags, alternatives=[frozenset(sorted(x)[:each]) for x in found])
