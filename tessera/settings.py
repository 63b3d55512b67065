"""Index settings and search requests, with the defaults that change results."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

MAX_LIMIT, MAX_OFFSET, MAX_QUERY, MAX_FACETS, MAX_CHILDREN = 100, 10_000, 1_000, 20, 50


@dataclass(frozen=True)
class Arabic:
    alef: bool = True
    ya: bool = True
    taa_marbuta: bool = False
    tatweel: bool = True
    diacritics: bool = True
    light_stem: bool = True


@dataclass(frozen=True)
class IndexSettings:
    """What an index version is built with; changes take effect only in a new version."""

    boosts: dict[str, float] = field(default_factory=lambda: {"title": 4.0, "headings": 2.5, "content": 1.0})
    k1: float = 1.2
    b: float = 0.75
    arabic: Arabic = Arabic()
    stop_words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    typo: bool = True
    max_distance: int = 2
    min_token_length: int = 4
    prefix: bool = True
    nfkc: bool = True

    def overlaid(self, *layers: dict) -> IndexSettings:
        """Later layers win: defaults, then the project's settings, then the index's."""
        out = self
        for layer in layers:
            out = replace(out, **{k: v for k, v in layer.items() if v is not None})
        return out

    def json(self) -> str:
        return json.dumps(self, default=lambda o: o.__dict__, sort_keys=True)


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    filters: dict | None = None
    facets: tuple[str, ...] = ()
    sort: tuple[str, str] | None = None  # field and "asc" or "desc"
    limit: int = 20
    offset: int = 0
    cursor: str | None = None
    typo: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
        if not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError(f"offset must be 0 to {MAX_OFFSET}")
        if len(self.query) > MAX_QUERY:
            raise ValueError(f"a query has at most {MAX_QUERY} characters")
        if len(self.facets) > MAX_FACETS:
            raise ValueError(f"at most {MAX_FACETS} facets")
