"""Request parameters as the search form sends them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


def empty_as_none_int(x: str | None) -> int | None:
    """None for a missing or empty value; anything that is no integer is an error."""
    return None if x is None or x == "" else int(x)


def empty_as_none_str(x: str | None) -> str | None:
    return (x or "").strip() or None


def parse_tags(x: str | None) -> list[str]:
    return [t for t in (line.strip() for line in (x or "").split("\n")) if t]


def checked_date(x: str | None) -> date | None:
    """An ISO date; a malformed bound raises."""
    x = empty_as_none_str(x)
    return None if x is None else date.fromisoformat(x)


@dataclass
class SearchParams:
    q: str = ""
    program_id: int | None = None
    episode: int | None = None
    subtitle: str = ""
    date_from: str | None = None
    date_to: str | None = None
    tags: list[str] = field(default_factory=list)
    filter: str = "all"
    page: int = 0

    @property
    def active_q(self) -> str | None:
        """The query counts from two bytes on, so one kana is enough."""
        q = self.q.strip()
        return q if len(q.encode()) >= 2 else None

    def anything(self) -> bool:
        """Whether the search runs at all: without any condition it returns nothing."""
        return bool(self.active_q or self.program_id is not None or self.episode is not None or self.subtitle.strip() or empty_as_none_str(self.date_from) or empty_as_none_str(self.date_to) or self.tags or self.filter != "all")


@dataclass
class Page:
    page: int
    total: int
    size: int = 50

    def __post_init__(self):
        self.page = min(max(self.page, 0), 1_000_000)

    @property
    def offset(self) -> int:
        return self.page * self.size

    @property
    def loaded(self) -> int:
        return min((self.page + 1) * self.size, self.total)

    @property
    def has_next(self) -> bool:
        return (self.page + 1) * self.size < self.total
