"""Named strategies: the last registration of a name wins, aliases point to names."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Entry:
    name: str
    build: Any
    about: str


@dataclass
class Registry:
    kind: str
    entries: dict[str, Entry] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def push(self, name: str, build: Any = None, about: str = "", aliases: tuple[str, ...] = ()):
        """Register; without `build`, a decorator."""
        if build is None:
            return lambda f: self.push(name, f, about or (f.__doc__ or "").strip(), aliases)
        self.entries[name] = Entry(name, build, about)
        for a in aliases:
            self.aliases[a] = name
        return build

    def add_alias(self, old: str, new: str) -> None:
        self.aliases[new] = old

    def get(self, name: str) -> Any:
        found = self.entries.get(self.aliases.get(name, name))
        if found is None:
            raise ValueError(f"no {self.kind} named {name!r}; there are: {', '.join(sorted(self.entries))}")
        return found.build

    def describe(self) -> list[tuple[str, str]]:
        """Name and summary of each entry, for help texts."""
        return [(e.name, e.about.splitlines()[0] if e.about else "") for _, e in sorted(self.entries.items())]
