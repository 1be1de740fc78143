"""What the columns of a frame of reads mean.

Every string type is a struct column (str, qual, origin, idx), every label a nullable (start, len) struct, every attribute
a nullable tagged struct; null means absent. Which labels and attributes can be there is known from the plan, so columns
stay plain and those that nothing needs are pruned. Column names are generated: Spark's names ignore case, labels do not.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..names import Attr, Label


@dataclass(frozen=True)
class Schema:
    types: dict[str, bool] = field(default_factory=dict)  #: string type: whether it has qualities
    labels: dict[Label, str] = field(default_factory=dict)
    attrs: dict[Attr, str] = field(default_factory=dict)
    sure: frozenset[Label] = frozenset()  #: labels that every read has
    made: int = 0

    @staticmethod
    def column(kind: str) -> str:
        return f"_{kind}"

    def with_label(self, name: Label, sure: bool) -> Schema:
        col = self.labels.get(name, f"_m{self.made}")
        return replace(self, labels={**self.labels, name: col}, sure=self.sure | {name} if sure else self.sure, made=self.made + (name not in self.labels))

    def with_attr(self, name: Attr) -> Schema:
        col = self.attrs.get(name, f"_a{self.made}")
        return replace(self, attrs={**self.attrs, name: col}, made=self.made + (name not in self.attrs))

    def columns(self) -> list[str]:
        return [*map(self.column, self.types), *self.labels.values(), *self.attrs.values()]

    def of_type(self, kind: str) -> dict[Label, str]:
        return {k: c for k, c in self.labels.items() if k.type == kind}
