r"""Templates: texts with labels and attributes filled in.

``{seq1.bc}`` is the label's bytes, ``{seq1.bc.hit}`` the attribute as text, ``{'AC'}`` a literal; ``{x; 4}`` repeats,
``{x; |seq1.bc|}`` as often as the label (or a text attribute) is long, ``{x; seq1.bc.n}`` as the attribute counts. ``\``
takes the next character as it is. Nothing is evaluated that is repeated no times.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from ..errors import ExpressionError
from ..names import Attr, Label, attr, parse_name


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Fill:
    what: Label | Attr


@dataclass(frozen=True)
class LengthOf:
    what: Label | Attr


@dataclass(frozen=True)
class CountOf:
    what: Attr


@dataclass(frozen=True)
class Repeat:
    part: Text | Fill
    times: int | LengthOf | CountOf


Part = Text | Fill | Repeat


def _split(inside: str) -> tuple[str, str | None]:
    """At the first ; outside quotes."""
    quoted = False
    for i, c in enumerate(inside):
        if c == "'":
            quoted = not quoted
        elif c == ";" and not quoted:
            return inside[:i].strip(), inside[i + 1 :].strip()
    return inside.strip(), None


def _filled(inside: str) -> Part:
    what, times = _split(inside)
    part = Text(what[1:-1]) if len(what) > 1 and what[0] == what[-1] == "'" else Fill(parse_name(what))
    if times is None:
        return part
    if len(times) > 1 and times[0] == times[-1] == "|":
        return Repeat(part, LengthOf(parse_name(times[1:-1])))
    if times.isdigit():
        return Repeat(part, int(times))
    return Repeat(part, CountOf(attr(times)))


def template(text: str | tuple) -> tuple[Part, ...]:
    return text if isinstance(text, tuple) else _parsed(text)


@lru_cache(4096)
def _parsed(text: str) -> tuple[Part, ...]:
    parts: list[Part] = []
    plain, inside, i = "", None, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
            if i == len(text):
                raise ExpressionError(f"template {text!r} ends with a lone \\")
            c, held = text[i], True
        else:
            held = False
        if not held and c == "{":
            if inside is not None:
                raise ExpressionError(f"template {text!r} has a brace within braces")
            if plain:
                parts.append(Text(plain))
            plain, inside = "", ""
        elif not held and c == "}":
            if inside is None:
                raise ExpressionError(f"template {text!r} closes a brace that was not opened")
            parts.append(_filled(inside))
            inside = None
        elif inside is None:
            plain += c
        else:
            inside += c
        i += 1
    if inside is not None:
        raise ExpressionError(f"template {text!r} leaves a brace open")
    if plain:
        parts.append(Text(plain))
    return tuple(parts)
