"""How columns get their values: recipes, table plans, and our own word lists."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Own word lists for names and texts.
LEXICON = {
    "first_name": ["Ada", "Bruno", "Chiara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Katya", "Liam", "Mona", "Nils", "Olga", "Pavel", "Quinn", "Rosa", "Sven", "Tara"],
    "last_name": ["Abbot", "Berg", "Costa", "Dahl", "Engel", "Fabre", "Greco", "Holm", "Ivanov", "Jung", "Kraus", "Lopez", "Moreau", "Novak", "Olsen", "Petit", "Quist", "Rossi", "Stein", "Tanaka"],
    "city": ["Aldport", "Brookham", "Castel", "Dunfield", "Eastmere", "Fernvale", "Grantown", "Highmoor", "Irongate", "Juniper"],
    "word": ["amber", "birch", "copper", "delta", "ember", "fjord", "grove", "harbor", "indigo", "juniper", "karst", "lagoon", "meadow", "nectar", "onyx", "prairie"],
}


@dataclass(frozen=True)
class Recipe:
    """kind and its parameters: sequence, int_range, decimal_range, enum, boolean, constant, pattern, pool, date, datetime,
    fk, derived, aggregate."""

    kind: str
    args: dict = field(default_factory=dict)
    null_ratio: float = 0.0


@dataclass(frozen=True)
class TablePlan:
    table: str
    rows: int
    columns: dict[str, Recipe]
