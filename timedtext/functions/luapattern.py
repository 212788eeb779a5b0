"""Lua patterns as Java regular expressions.

Patterns in rule files keep Lua's syntax: ``%`` escapes, ``-`` as the lazy repeat, classes such as ``%d`` and ``%p``,
frontiers. Multi-byte characters count as one character here, where Lua counts bytes.
"""

from __future__ import annotations

CLASSES = {
    "a": "A-Za-z", "d": "0-9", "l": "a-z", "u": "A-Z", "s": r"\x09-\x0D\x20", "w": "A-Za-z0-9", "x": "A-Fa-f0-9", "c": r"\x00-\x1F\x7F",
    "p": r"!-/:-@\[-`{-~", "g": "!-~",
}


class BadPattern(ValueError):
    """A pattern that Lua would refuse too, or that has no regular equivalent."""


def _literal(ch: str) -> str:
    return "\\" + ch if not ch.isalnum() and ch.isascii() and not ch.isspace() and ch != "_" else ch


def _class(letter: str, inside: bool) -> str:
    members = CLASSES.get(letter.lower())
    if members is None:
        return _literal(letter)
    if letter.islower():
        return members if inside else f"[{members}]"
    return f"[^{members}]"


def _set(pattern: str, at: int) -> tuple[str, int, bool]:
    """The character set that opens at ``at``; gives it, the position after it, and whether NUL is in it."""
    k, out, nul = at + 1, [], False
    negated = pattern[k : k + 1] == "^"
    if negated:
        k += 1
    first = True
    while True:
        if k >= len(pattern):
            raise BadPattern("missing ]")
        ch = pattern[k]
        if ch == "]" and not first:
            break
        first = False
        if ch == "%":
            if k + 1 >= len(pattern):
                raise BadPattern("ends with %")
            letter = pattern[k + 1]
            out.append(_class(letter, True))
            nul |= letter == "c" or (letter.isupper() and letter != "C" and letter.lower() in CLASSES)
            k += 2
        elif pattern[k + 1 : k + 2] == "-" and pattern[k + 2 : k + 3] not in ("", "]"):
            out.append(f"{_literal(ch)}-{_literal(pattern[k + 2])}")
            k += 3
        else:
            out.append(_literal(ch))
            k += 1
    return f"[{'^' if negated else ''}{''.join(out)}]", k + 1, nul != negated


def to_java(pattern: str) -> str:
    """The regular expression that finds what the Lua pattern finds; raises BadPattern."""
    out, k, depth = [], 0, 0
    if pattern.startswith("^"):
        out.append("^")
        k = 1
    while k < len(pattern):
        ch = pattern[k]
        if ch == "(":
            if pattern[k + 1 : k + 2] == ")":
                raise BadPattern("position captures have no equivalent")
            out.append("(")
            depth += 1
            k += 1
            continue
        if ch == ")":
            depth -= 1
            if depth < 0:
                raise BadPattern("unexpected )")
            out.append(")")
            k += 1
            continue
        if ch == "$" and k == len(pattern) - 1:
            out.append(r"\z")
            k += 1
            continue
        if ch == "%":
            letter = pattern[k + 1 : k + 2]
            if not letter:
                raise BadPattern("ends with %")
            if letter == "b":
                raise BadPattern("balanced pairs have no equivalent")
            if letter == "f":
                if pattern[k + 2 : k + 3] != "[":
                    raise BadPattern("missing [ after %f")
                body, k, nul = _set(pattern, k + 2)
                # beyond either end of the text stands a NUL
                before = f"(?<!{body})" + ("(?<=(?s:.))" if nul else "")
                out.append(before + (f"(?:(?={body})|(?!(?s:.)))" if nul else f"(?={body})"))
                continue
            if letter.isdigit():
                out.append(f"\\{letter}")
                k += 2
                continue
            item, k = _class(letter, False), k + 2
        elif ch == "[":
            item, k, _ = _set(pattern, k)
        elif ch == ".":
            item, k = "(?s:.)", k + 1
        else:
            item, k = _literal(ch), k + 1
        repeat = pattern[k : k + 1]
        if repeat and repeat in "*+-?":
            k += 1
            item += {"*": "*", "+": "+", "-": "*?", "?": "?"}[repeat]
        out.append(item)
    if depth:
        raise BadPattern("unfinished capture")
    return "".join(out)


def replacement_to_java(text: str) -> str:
    """``%1`` and ``%%`` in a replacement, as Java writes them."""
    out, k = [], 0
    while k < len(text):
        if text[k] == "%" and k + 1 < len(text):
            nxt = text[k + 1]
            out.append(f"${nxt}" if nxt.isdigit() else _quoted(nxt))
            k += 2
        else:
            out.append(_quoted(text[k]))
            k += 1
    return "".join(out)


def _quoted(ch: str) -> str:
    return "\\" + ch if ch in "\\$" else ch
