"""Settings of an analysis: one declared table of what each may be, and one check for all of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple


class Setting(NamedTuple):
    """Default, type, and the open or closed range of a value; ``many`` is an increasing row of values."""

    default: Any
    kind: type
    low: float
    high: float
    open_ends: bool = False
    many: bool = False

    def fault(self, value: Any) -> str | None:
        row = value if self.many else (value,)
        if self.many and (not isinstance(value, (tuple, list)) or not row or list(row) != sorted(set(row))):
            return "must be an increasing row of values"
        for v in row:
            if type(v) is not self.kind and not (self.kind is float and type(v) is int):
                return f"must be of type {self.kind.__name__}"
            inside = self.low < v < self.high if self.open_ends else self.low <= v <= self.high
            if not inside:
                return f"must lie {'strictly ' if self.open_ends else ''}between {self.low} and {self.high}"
        return None


_MANY = 2**31 - 1
SETTINGS: dict[str, Setting] = {
    "min_tokens": Setting(50, int, 1, _MANY),
    "window": Setting(50, int, 1, _MANY),
    "segment": Setting(50, int, 1, _MANY),
    "hdd_sample": Setting(42, int, 1, _MANY),
    "mtld_threshold": Setting(0.72, float, 0, 1, open_ends=True),
    "seed": Setting(42, int, 0, _MANY),
    "n_levels": Setting(8, int, 1, _MANY),
    "cutoff": Setting(2, int, 0, _MANY),
    "thresholds": Setting((90, 95, 98), int, 1, 100, many=True),
}
#: Free choices: the unit of counting and the normalizer of list lookups.
CHOICES = {"unit": ("token",), "normalizer": ("flemma", "surface", "lemma")}

#: Notes that hold where their test does.
NOTES = (
    (lambda c: True, "Tokens are runs of ASCII letters with at most one apostrophe, in lower case."),
    (lambda c: True, "Undefined values are null."),
    (lambda c: c.min_tokens < SETTINGS["min_tokens"].default, "The minimum of tokens is lower than recommended."),
    (lambda c: c.normalizer != "surface", "List lookups fall back to the head given by the {normalizer} normalizer."),
)


class AnalysisConfig(Mapping):
    """Immutable, checked settings; read as attributes or as a mapping. Values become literals of the plans."""

    def __init__(self, **given: Any):
        if unknown := given.keys() - SETTINGS.keys() - CHOICES.keys():
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values = {k: given.get(k, s.default) for k, s in SETTINGS.items()} | {k: given.get(k, c[0]) for k, c in CHOICES.items()}
        faults = [f"{k} {said}" for k, s in SETTINGS.items() if (said := s.fault(values[k]))]
        faults += [f"{k} must be one of {c}" for k, c in CHOICES.items() if values[k] not in c]
        if faults:
            raise ValueError("; ".join(faults))
        object.__setattr__(self, "_values", {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def __getattr__(self, name: str) -> Any:
        try:
            return object.__getattribute__(self, "_values")[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("settings do not change")

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def __reduce__(self):
        return _made, (dict(self._values),)

    def notes(self) -> list[str]:
        return [text.format(**self._values) for test, text in NOTES if test(self)]


def _made(values: dict) -> AnalysisConfig:
    return AnalysisConfig(**values)
