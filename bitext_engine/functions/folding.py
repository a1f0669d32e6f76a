"""Text that hides its letters: other forms of letters, blanks that do not break, characters without width.

A rule meant for plain text is rewritten so that it matches such text where it stands. Every letter of the pattern becomes a class of
its forms, every blank one of all blanks, and after each there may be characters without width. Hits and replacements so
lie in the text itself: nothing has to be mapped back, and what surrounds a hit keeps every character. `folded` gives
the plain form of a text, for looking whether a rule can match at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters without width: soft hyphen, joiners, marks of direction, word joiner, variation selectors, byte order mark
NO_WIDTH = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
# blanks other than space and tab
BLANKS = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# letters of other alphabets that look the same, in both cases (fixed values)
LOOK_ALIKE = {
    "a": "аАαΑ", "c": "сС\u1c83", "e": "еЕ", "i": "іІ", "j": "јЈ", "o": "оО\u1c82οΟ", "p": "рР", "s": "ѕЅſ", "x": "хХ", "y": "уУ",
    "k": "\u212a", "h": "\u210e\u210b\u210c\u210d", "l": "\u2113\u2112", "g": "\u210a", "b": "\u212c", "f": "\u2131", "r": "\u211b\u211c\u211d", "m": "\u2133",
}
# two letters as one (fixed values)
LIGATURES = {"ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "st": "ﬅﬆ"}


def forms(char: str) -> list[int]:
    """Code points that stand for a visible ASCII character, without itself; for letters, in both cases."""
    found = [ord(char) + 0xFEE0]
    if char.isalpha():
        low, place = char.lower(), ord(char.lower()) - ord("a")
        found = [ord(c) + 0xFEE0 for c in (low, low.upper())]
        # thirteen styles of mathematical letters, 26 capital and 26 small ones each
        found += [0x1D400 + 52 * style + place + case for style in range(13) for case in (0, 26)]
        # in brackets, in circles, in squares
        found += [0x249C + place, 0x1F110 + place, 0x24B6 + place, 0x24D0 + place, 0x1F130 + place, 0x1F150 + place, 0x1F170 + place]
        found += [ord(c) for c in LOOK_ALIKE.get(low, "")]
    return found


def _ranges(pairs) -> str:
    return "".join(chr(a) + (f"-{chr(b)}" if b > a else "") for a, b in pairs)


_Z = f"[{_ranges(NO_WIDTH)}]*"
_ALL_LETTERS = _ranges((n, n) for n in sorted({n for c in "abcdefghijklmnopqrstuvwxyz" for n in forms(c)}))


def _literal(char: str) -> str:
    if char == " ":
        return f"[ {_ranges(BLANKS)}]"
    if not "!" <= char <= "~":
        return re.escape(char)
    own = (char.lower() + char.upper()) if char.isalpha() else ("\\" + char if char in "\\]^-[" else char)
    return f"[{own}{_ranges((n, n) for n in sorted(forms(char)))}]"


_ATOM = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-z]+\)|\(\?:|[()|^$?*+]|\{[0-9,]+\}|.", re.DOTALL)


def hidden(pattern: str) -> str:
    """The pattern, matching also what only looks like its text. It may hold literals, classes, groups, alternatives, anchors
    and quantifiers; letters in it stand for both cases, as they would under (?i). Groups keep their numbers."""
    out: list[str] = []
    atoms = _ATOM.findall(pattern)
    i = 0
    while i < len(atoms):
        atom = atoms[i]
        after_one, after = (atoms[i + k] if i + k < len(atoms) else "" for k in (1, 2))
        pair = (atom + atoms[i + 1]).lower() if i + 1 < len(atoms) and len(atom) == len(atoms[i + 1]) == 1 else ""
        if pair in LIGATURES and not re.match(r"[?*+{]", after):
            out.append(f"(?:{_literal(atom)}{_Z}{_literal(pair[1])}{_Z}|[{LIGATURES[pair]}]{_Z})")
            i += 2
            continue
        if atom[0] == "[" or (atom == " " and after_one in ("*", "+")):
            inner = atom[1:-1] if atom[0] == "[" else " "
            if not inner.startswith("^"):
                inner += _ranges(BLANKS) * (" " in inner) + _ALL_LETTERS * ("A-Z" in inner)
                # a run is one class, not a repeated group, which would be followed by recursion
                if after_one in ("*", "+"):
                    out.append(("" if after_one == "*" else f"[{inner}]") + f"[{inner}{_ranges(NO_WIDTH)}]*")
                    i += 2
                    continue
            out.append(f"(?:[{inner}]{_Z})")
        elif atom == "^":
            out.append(f"^{_Z}")
        elif atom == "\\n":
            out.append(f"(?:\\n{_Z})")
        elif atom[0] == "\\" and len(atom) == 2 and not atom[1].isalnum():
            out.append(f"(?:{_literal(atom[1])}{_Z})")
        elif atom[0] in "\\(){}|$?*+":
            out.append(atom)
        else:
            out.append(f"(?:{_literal(atom)}{_Z})")
        i += 1
    return "".join(out)


_CLASS = re.compile(r"(\\x\{[0-9A-Fa-f]+\}|\\.)|\[(?!\^)(?:\\.|[^\]\\\[])+\]", re.DOTALL)


def guarded(pattern: str) -> str:
    """The same pattern, faster: a class with characters from U+0100 on is asked only if one look at a character does not rule it
    out, as Java asks its many ranges one by one. What it matches does not change."""

    def guard(found: re.Match) -> str:
        inner = found.group()
        if found.group(1) or "\\x{" in inner or "&&" in inner or max(inner) < "\u0100":
            return inner
        low = "".join(f"\\x{{{n:x}}}" for n in range(0x100) if re.fullmatch(inner, chr(n)))
        return f"[[{low}\\x{{100}}-\\x{{10FFFF}}]&&{inner}]"

    return _CLASS.sub(guard, pattern)


def _table() -> tuple[str, str]:
    known: dict[int, str] = {}
    for code in range(ord("!"), ord("~") + 1):
        if not chr(code).isupper():
            for n in forms(chr(code)):
                known.setdefault(n, chr(code))
    for a, b in BLANKS:
        known.update((n, " ") for n in range(a, b + 1))
    gone = "".join(chr(n) for a, b in NO_WIDTH for n in range(a, b + 1))
    return "".join(map(chr, known)) + gone, "".join(known.values())


_FROM, _TO = _table()
# no character below U+0100 hides anything but these two
_MAY_HIDE = r"[\x{A0}\x{AD}\x{100}-\x{10FFFF}]"


def folded(col: Column) -> Column:
    """Lower case, in plain letters and blanks, without characters that have no width."""
    def fold(text: Column) -> Column:
        plain = F.lower(text)
        for pair, signs in LIGATURES.items():
            for sign in signs:
                plain = F.replace(plain, F.lit(sign), F.lit(pair))
        return F.when(text.rlike(_MAY_HIDE), F.translate(plain, _FROM, _TO)).otherwise(F.lower(text))

    # the text is named once, whatever expression it is
    return F.get(F.transform(F.array(col), fold), F.lit(0))
