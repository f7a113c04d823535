"""Patterns of the RE2 dialect as Java patterns that match the same text."""

from __future__ import annotations

import re
from functools import lru_cache


class UnsupportedPattern(ValueError):
    """A construct that RE2 does not compile."""


SPACE = r"\t\n\f\r "


@lru_cache(maxsize=4096)
def to_java(pattern: str, ignorecase: bool = False) -> str:
    """Translate one pattern; ``ignorecase`` acts unless the pattern sets the flag itself."""
    if ignorecase and "(?i)" not in pattern:
        pattern = "(?i)" + pattern
    out, i, n = [], 0, len(pattern)
    in_class = start_of_class = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise UnsupportedPattern(f"trailing backslash in {pattern!r}")
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find(r"\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else n]
                out.append(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text))
                i = n if end < 0 else end + 2
                continue
            if (d.isdigit() and d != "0") or d in "CkGXRZHhNcue":
                raise UnsupportedPattern(f"\\{d} in {pattern!r}")
            if d == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif d == "S":
                out.append(_not_space_in_class() if in_class else f"[^{SPACE}]")
            elif d == "v":
                out.append(r"\x0B")
            elif d == "z":
                out.append(r"\z")
            elif d == "p" or d == "P":
                m = re.match(r"\\[pP](\{\^?\w+\}|\w)", pattern[i:])
                if not m:
                    raise UnsupportedPattern(pattern)
                name, negative = m[1].strip("{}"), d == "P"
                if name.startswith("^"):
                    name, negative = name[1:], not negative
                out.append(f"\\{'P' if negative else 'p'}{{{'Is' if len(name) > 2 else ''}{name}}}")
                i += len(m[0])
                start_of_class = False
                continue
            else:
                out.append("\\" + d)
            i += 2
            start_of_class = False
            continue
        if in_class:
            if c == "]" and not start_of_class:
                in_class = False
                out.append("]")
            elif c == "[" and pattern[i : i + 2] == "[:":
                end = pattern.index(":]", i)
                name, negative = pattern[i + 2 : end].lstrip("^"), pattern[i + 2] == "^"
                java = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}.get(name)
                out.append(("\\P" if negative else "\\p") + "{" + java + "}" if java else (r"\W" if negative else r"\w"))
                i = end + 2
                start_of_class = False
                continue
            elif c in "[]":
                out.append("\\" + c)
            elif c == "&" and pattern[i : i + 2] == "&&":
                out.append(r"\&")
            else:
                out.append(c)
            start_of_class = start_of_class and c == "^" and out[-2:] == ["[", "^"]
            i += 1
            continue
        if c == "[":
            in_class = start_of_class = True
            out.append("[")
        elif c == "$":
            out.append(r"\z" if not _multiline(pattern[:i]) else r"(?=\n|\z)")
        elif c == "(" and pattern[i : i + 2] == "(?":
            m = re.match(r"\(\?(?:P?<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)]))", pattern[i:])
            if not m:
                raise UnsupportedPattern(f"{pattern[i : i + 4]!r} in {pattern!r}")
            if m[1]:
                out.append(f"(?<{m[1].replace('_', 'u')}>")
            else:
                if "U" in m[2]:
                    raise UnsupportedPattern(f"swapped greediness in {pattern!r}")
                on, _, off = m[2].partition("-")
                flags = on.replace("i", "iu") + ("-" + off.replace("i", "iu") if off else "")
                out.append(f"(?{flags}{m[3]}")
            i += len(m[0])
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise UnsupportedPattern(f"possessive quantifier in {pattern!r}")
        else:
            out.append(c)
        i += 1
    java = "(?d)" + "".join(out)
    return java


def _not_space_in_class() -> str:
    return r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}"


def _multiline(before: str) -> bool:
    return bool(re.search(r"\(\?[is]*m", before))


def group_count(pattern: str) -> int:
    """Capturing groups of a pattern."""
    count, in_class, i = 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            if pattern[i : i + 1] == "]":
                i += 1
            continue
        if c == "]":
            in_class = False
        elif c == "(" and not in_class and (pattern[i + 1 : i + 2] != "?" or re.match(r"\(\?P?<\w", pattern[i:])):
            count += 1
        i += 1
    return count


def may_be_empty(pattern: str) -> bool:
    """Whether a pattern can match nothing (judged on the empty text and on a word)."""
    try:
        p = re.compile(pattern.replace(r"\z", r"\Z").replace("(?P<", "(?P<"))
    except re.error:
        return True
    return any(not m.group() for m in [*p.finditer(""), *p.finditer("a b")])
