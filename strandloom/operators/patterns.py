"""Lists of patterns, and the kinds of match that hold them against a label's bytes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import ExpressionError
from ..functions.template import template
from ..names import checked


@dataclass(frozen=True)
class Pattern:
    template: tuple
    attrs: dict[str, bool | int | str] = field(default_factory=dict)


@dataclass(frozen=True)
class Patterns:
    """A name, under which the pattern that matched is noted (None: nowhere), and patterns in order. All have the same
    attributes, which are noted with the match."""

    name: str | None
    patterns: tuple[Pattern, ...]

    def __post_init__(self):
        if not self.patterns:
            raise ExpressionError("a pattern list needs a pattern")
        keys = self.patterns[0].attrs.keys()
        for p in self.patterns:
            if p.attrs.keys() != keys:
                raise ExpressionError("all patterns of a list need the same attributes")

    @property
    def attr_names(self) -> list[str]:
        return sorted(self.patterns[0].attrs)

    @classmethod
    def of(cls, name: str | None, patterns: list) -> Patterns:
        """Patterns as templates, or (template, attributes)."""
        pairs = [(p, {}) if isinstance(p, str) else p for p in patterns]
        return cls(None if name is None else checked(name), tuple(Pattern(template(t), {checked(k): v for k, v in a.items()}) for t, a in pairs))

    @classmethod
    def from_yaml(cls, text: str) -> Patterns:
        """``name`` and ``patterns``: each with ``pattern`` and any attributes, tagged !Bool, !UInt or !String."""
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        def uint(loader, node):
            n = int(loader.construct_scalar(node))
            if n < 0:
                raise ExpressionError(f"!UInt {n} is negative")
            return n

        def truth(loader, node):
            s = loader.construct_scalar(node)
            if s not in ("true", "false"):
                raise ExpressionError(f"!Bool {s} is neither true nor false")
            return s == "true"

        Loader.add_constructor("!Bool", truth)
        Loader.add_constructor("!UInt", uint)
        Loader.add_constructor("!String", lambda loader, node: str(loader.construct_scalar(node)))
        try:
            got = yaml.load(text, Loader)  # noqa: S506  a safe loader with three tags more
            rows = [(str(p.pop("pattern")), p) for p in map(dict, got["patterns"])]
            return cls.of(str(got["name"]), rows)
        except (yaml.YAMLError, KeyError, TypeError) as e:
            raise ExpressionError(f"pattern list: {e}") from e


@dataclass(frozen=True)
class Count:
    """At least so many bytes equal."""

    n: int

    def least(self, length: int) -> int:
        return self.n


@dataclass(frozen=True)
class Frac:
    """At least this share of the pattern equal, rounded down to bytes."""

    f: float

    def least(self, length: int) -> int:
        return int(self.f * length)


@dataclass(frozen=True)
class MatchType:
    """``family``: exact, hamming or aln; ``place``: whole, prefix, suffix, search (local, for alignments)."""

    family: str
    place: str
    threshold: Count | Frac | None = None
    identity: float = 0.0
    overlap: float = 0.0

    @property
    def n_labels(self) -> int:
        return {"whole": 1, "prefix": 2, "suffix": 2, "search": 3}[self.place]

    def window(self, length: int) -> int:
        """Bytes at the read's end that an end alignment looks at."""
        return length + math.ceil((1.0 - self.identity) * length)


Exact, ExactPrefix, ExactSuffix, ExactSearch = (MatchType("exact", p) for p in ("whole", "prefix", "suffix", "search"))


def Hamming(t: Count | Frac) -> MatchType:  # noqa: N802
    return MatchType("hamming", "whole", t)


def HammingPrefix(t: Count | Frac) -> MatchType:  # noqa: N802
    return MatchType("hamming", "prefix", t)


def HammingSuffix(t: Count | Frac) -> MatchType:  # noqa: N802
    return MatchType("hamming", "suffix", t)


def HammingSearch(t: Count | Frac) -> MatchType:  # noqa: N802
    return MatchType("hamming", "search", t)


def GlobalAln(identity: float) -> MatchType:  # noqa: N802
    return MatchType("aln", "whole", None, identity, identity)


def LocalAln(identity: float, overlap: float) -> MatchType:  # noqa: N802
    return MatchType("aln", "search", None, identity, overlap)


def PrefixAln(identity: float, overlap: float) -> MatchType:  # noqa: N802
    return MatchType("aln", "prefix", None, identity, overlap)


def SuffixAln(identity: float, overlap: float) -> MatchType:  # noqa: N802
    return MatchType("aln", "suffix", None, identity, overlap)
