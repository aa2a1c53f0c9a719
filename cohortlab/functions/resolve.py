"""Finding columns by name before a query is built (no row work)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Resolution:
    """What a search for columns came to: one column each, none, or several to choose from."""

    found: dict[str, str] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)


class ColumnIndex:
    """Column names, folded once, searched by terms that must all occur."""

    def __init__(self, columns: list[str]):
        self._exact = frozenset(columns)
        self._folded = [(c.casefold(), c) for c in columns]

    def matches(self, *terms: str) -> list[str]:
        """Columns whose name holds every term, in table order, case aside."""
        folded = [t.casefold() for t in terms]
        return [name for key, name in self._folded if all(t in key for t in folded)]

    def resolve(self, exact: dict[str, str], *terms: str, first: bool = False) -> Resolution:
        """One column per label: the one named in `exact` where the table has it, else the only one that holds the label and `terms`.

        Several candidates are reported as ambiguous rather than chosen from; with `first` the first in table order is taken, and one
        warning names the choices.
        """
        here = {label: name for label, name in exact.items() if name in self._exact}
        options = {label: self.matches(label, *terms) for label in exact if label not in here}
        if first and (chosen := {label: names for label, names in options.items() if len(names) > 1}):
            warnings.warn("; ".join(f"{label}: took {names[0]} of {', '.join(names)}" for label, names in chosen.items()), stacklevel=2)
            options = {label: names[:1] for label, names in options.items()}
        return Resolution(
            found=here | {label: names[0] for label, names in options.items() if len(names) == 1},
            missing=[label for label, names in options.items() if not names],
            ambiguous={label: names for label, names in options.items() if len(names) > 1},
        )


def present_columns(columns: list[str], wanted: list[str]) -> tuple[list[str], list[str]]:
    """Split `wanted` into (present, missing); the missing ones are named in one warning."""
    have = frozenset(columns)
    missing = [c for c in wanted if c not in have]
    if missing:
        warnings.warn(f"columns not found: {', '.join(missing)}", stacklevel=2)
    return [c for c in wanted if c in have], missing
