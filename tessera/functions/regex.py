"""ECMA-262 patterns: translation to Java's and Python's dialects, and a three-valued search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import regex

#: Seconds after which a search is undecided.
TIME_LIMIT = 0.25

# The classes that ECMA-262 defines, as items of a bracket expression.
DIGIT, WORD = "0-9", "A-Za-z0-9_"
SPACE = ("\t\n\x0b\x0c\r    -     　﻿", "-")
LINE_ENDS = "\n\r  "
CONTROL = {"t": "\t", "n": "\n", "v": "\x0b", "f": "\x0c", "r": "\r", "0": "\0"}
CATEGORIES = {
    "Letter": "L", "Lowercase_Letter": "Ll", "Uppercase_Letter": "Lu", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Nonspacing_Mark": "Mn", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me", "Number": "N", "Decimal_Number": "Nd", "Letter_Number": "Nl",
    "Other_Number": "No", "Punctuation": "P", "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Separator": "Z", "Space_Separator": "Zs", "Control": "Cc", "Other": "C",
}


class Unsupported(ValueError):
    """The pattern isn't ECMA-262, or it has no equal in the other dialect."""


@dataclass(frozen=True)
class Translation:
    java: str | None  # None: no sound equal
    python: str | None
    slow: bool  # nested repeats: only with a time limit


class _Translator:
    def __init__(self, pattern: str, java: bool) -> None:
        self.p, self.i, self.java = pattern, 0, java
        self.slow = False

    def char(self, c: str) -> str:
        """A literal character, safe everywhere."""
        if c.isascii() and c.isalnum():
            return c
        return f"\\x{{{ord(c):x}}}" if self.java else (f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}")

    def space(self) -> str:
        chars, _ = SPACE
        out, i = [], 0
        while i < len(chars):
            if chars[i + 1 : i + 2] == "-":
                out.append(f"{self.char(chars[i])}-{self.char(chars[i + 2])}")
                i += 3
            else:
                out.append(self.char(chars[i]))
                i += 1
        return "".join(out)

    def run(self) -> str:
        out, _ = self.alternatives(0)
        if self.i < len(self.p):
            raise Unsupported("unmatched )")
        return out

    def alternatives(self, depth: int) -> tuple[str, bool]:
        """Until the group's end; whether anything inside repeats without bound."""
        out, loops = [], False
        while self.i < len(self.p) and self.p[self.i] != ")":
            if self.p[self.i] == "|":
                self.i += 1
                out.append("|")
                continue
            atom, atom_loops, assertion = self.atom(depth)
            times = self.repeat()
            if times and assertion:
                raise Unsupported("a repeated assertion")
            endless = bool(times) and (times[0] in "*+" or times.rstrip("?").endswith(",}"))
            if endless and atom_loops:
                self.slow = True
            loops |= endless or atom_loops
            out.append(atom + times)
        return "".join(out), loops

    def repeat(self) -> str:
        m = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??").match(self.p, self.i)
        if not m:
            return ""
        self.i = m.end()
        return m[0]

    def atom(self, depth: int) -> tuple[str, bool, bool]:
        c = self.p[self.i]
        if c == "(":
            return self.group(depth)
        self.i += 1
        if c == "[":
            return self.bracket(), False, False
        if c == "\\":
            return self.escape()
        if c == ".":
            return f"[^{''.join(map(self.char, LINE_ENDS))}]", False, False
        if c == "^":
            return "^", False, True
        if c == "$":
            return (r"\z" if self.java else r"\Z"), False, True
        if c in "*+?":
            raise Unsupported("nothing to repeat")
        return self.char(c), False, False

    def group(self, depth: int) -> tuple[str, bool, bool]:
        m = re.compile(r"\((\?:|\?=|\?!|\?<=|\?<!|\?<[A-Za-z_$][\w$]*>)?").match(self.p, self.i)
        kind = m[1] or ""
        if not kind and self.p[self.i : self.i + 2] == "(?":
            raise Unsupported("unknown group")
        self.i = m.end()
        inside, loops = self.alternatives(depth + 1)
        if self.i >= len(self.p):
            raise Unsupported("unmatched (")
        self.i += 1
        behind = kind in ("?<=", "?<!")
        if behind and loops and self.java:
            raise Unsupported("unbounded lookbehind")
        open_ = kind if kind in ("?=", "?!", "?<=", "?<!") else "?:"
        return f"({open_}{inside})", loops, kind in ("?=", "?!", "?<=", "?<!")

    def code(self, c: str) -> str | None:
        """The character that an escape stands for, if it is one."""
        if c in CONTROL:
            if c == "0" and self.p[self.i : self.i + 1].isdigit():
                raise Unsupported("octal escape")
            return CONTROL[c]
        for start, form in (("u", r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})"), ("x", r"([0-9a-fA-F]{2})")):
            if c == start:
                m = re.compile(form).match(self.p, self.i)
                if not m:
                    raise Unsupported(f"bad \\{c}")
                self.i = m.end()
                value = int(next(g for g in m.groups() if g), 16)
                low = re.compile(r"\\u(d[c-f][0-9a-f]{2})", re.IGNORECASE).match(self.p, self.i)
                if 0xD800 <= value < 0xDC00 and low:
                    self.i = low.end()
                    value = 0x10000 + ((value - 0xD800) << 10) + int(low[1], 16) - 0xDC00
                if value > 0x10FFFF or 0xD800 <= value < 0xE000:
                    raise Unsupported("not a character")
                return chr(value)
        if c == "c":
            m = re.compile("[A-Za-z]").match(self.p, self.i)
            if not m:
                raise Unsupported("bad \\c")
            self.i += 1
            return chr(ord(m[0]) % 32)
        return None if c.isalnum() else c

    def category(self, c: str) -> str:
        m = re.compile(r"\{(?:(General_Category|gc|Script|sc)=)?(\w+)\}").match(self.p, self.i)
        if not m:
            raise Unsupported("bad property")
        self.i = m.end()
        if (m[1] or "").lower().startswith("sc"):
            return f"\\{c}{{{'Is' if self.java else 'Script='}{m[2]}}}"
        name = CATEGORIES.get(m[2], m[2])
        if name not in CATEGORIES.values() and not re.fullmatch("[LMNPSZC][a-z]?", name):
            raise Unsupported(f"property {name}")
        return f"\\{c}{{{name}}}"

    def escape(self) -> tuple[str, bool, bool]:
        if self.i >= len(self.p):
            raise Unsupported("trailing \\")
        c = self.p[self.i]
        self.i += 1
        if c in "dDwWsS":
            items = {"d": DIGIT, "w": WORD, "s": self.space()}[c.lower()]
            return f"[{'^' if c.isupper() else ''}{items}]", False, False
        if c in "bB":
            inner = f"(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}])" if c == "b" else f"(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}])"
            return f"(?:{inner})", False, True
        if c in "pP":
            return self.category(c), False, False
        if c in "123456789k":
            raise Unsupported("a backreference")  # to a group that took no part it matches nothing there, and always here
        char = self.code(c)
        if char is None:
            raise Unsupported(f"escape \\{c}")
        return self.char(char), False, False

    def bracket(self) -> str:
        negated = self.p[self.i : self.i + 1] == "^"
        self.i += negated
        items: list[tuple[str, str | None]] = []  # (text, character if it is one)
        while True:
            if self.i >= len(self.p):
                raise Unsupported("unmatched [")
            c = self.p[self.i]
            self.i += 1
            if c == "]":
                break
            if c != "\\":
                items.append(("-" if c == "-" else self.char(c), c))
                continue
            e = self.p[self.i : self.i + 1]
            self.i += 1
            if e in tuple("dws"):
                items.append(({"d": DIGIT, "w": WORD, "s": self.space()}[e], None))
            elif e in tuple("DWS"):
                items.append((f"[^{ {'d': DIGIT, 'w': WORD, 's': self.space()}[e.lower()] }]", None))
            elif e in tuple("pP"):
                items.append((self.category(e), None))
            elif e in ("b", "-"):
                items.append((self.char("\b" if e == "b" else "-"), "\b" if e == "b" else "\\-"))
            else:
                char = self.code(e) if e else None
                if char is None:
                    raise Unsupported(f"escape \\{e}")
                items.append((self.char(char), char))
        out, i = [], 0
        while i < len(items):
            if i + 2 < len(items) and items[i + 1][0] == "-" and items[i][1] and items[i + 2][1]:
                low, high = (x[1][-1] for x in (items[i], items[i + 2]))
                if low > high:
                    raise Unsupported("range out of order")
                out.append(f"{self.char(low)}-{self.char(high)}")
                i += 3
            else:
                out.append(self.char("-") if items[i][0] == "-" else items[i][0])
                i += 1
        if not out:
            return "(?!)" if not negated else ("[\\x{0}-\\x{10ffff}]" if self.java else "[\\u0000-\\U0010ffff]")
        return f"[{'^' if negated else ''}{''.join(out)}]"


@lru_cache(maxsize=4096)
def translate(pattern: str) -> Translation:
    found: dict[bool, str | None] = {}
    slow = False
    for java in (True, False):
        try:
            t = _Translator(pattern, java)
            found[java] = t.run()
            slow |= t.slow
        except Unsupported:
            found[java] = None
    if found[False] is not None:
        try:
            regex.compile(found[False], regex.V1)
        except regex.error:
            found = {True: None, False: None}
    return Translation(found[True], found[False], slow)


@lru_cache(maxsize=4096)
def _compiled(pattern: str):
    form = translate(pattern).python
    return regex.compile(form, regex.V1) if form is not None else None


def search(pattern: str, text: str) -> bool | None:
    """Whether the pattern occurs in the text; None if that cannot be told (in time)."""
    found = _compiled(pattern)
    if found is None:
        return None
    try:
        return found.search(text, timeout=TIME_LIMIT) is not None
    except TimeoutError:
        return None
