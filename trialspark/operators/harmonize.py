"""One spelling per column: header clean-up and synonym harmonisation."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

# The default synonym map, {standard name: [names in the files]}.
DEFAULT_SYNONYMS: dict[str, list[str]] = {"numhospdka": ["Pt_NumHospDKA", "NumHospDKA"]}


def load_synonyms(path: str | Path) -> dict[str, list[str]]:
    """Synonym map from a JSON file; a missing file means no renames."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}


def unique_headers(cells: Iterable[str]) -> list[str]:
    """Header cells as distinct column names (case-insensitive).

    Cells are trimmed, an empty one becomes ``column<position>``, and a repeat
    of a name gets ``_1``, ``_2``, ... appended.
    """
    names: list[str] = []
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    for position, cell in enumerate(cells):
        wanted = cell.strip() or f"column{position}"
        name = wanted
        while name.lower() in taken:
            repeats[wanted.lower()] = repeats.get(wanted.lower(), 0) + 1
            name = f"{wanted}_{repeats[wanted.lower()]}"
        taken.add(name.lower())
        names.append(name)
    return names


def standard_names(
    columns: Sequence[str], synonyms: Mapping[str, Sequence[str]] = DEFAULT_SYNONYMS
) -> list[str]:
    """Harmonised name of each column, left to right.

    A column takes its standard name while that is free, else keeps its own
    name, else gets ``_2``, ``_3``, ... appended to its own name. Names compare
    case-insensitively.
    """
    standard = {own.lower(): std for std, owns in synonyms.items() for own in owns}
    taken: set[str] = set()

    def choose(column: str) -> str:
        candidates = [standard.get(column.lower(), column), column]
        free = next((c for c in candidates if c.lower() not in taken), None)
        suffix = 2
        while free is None:
            numbered = f"{column}_{suffix}"
            free = numbered if numbered.lower() not in taken else None
            suffix += 1
        taken.add(free.lower())
        return free

    return [choose(column) for column in columns]


def harmonize(
    df: DataFrame, synonyms: Mapping[str, Sequence[str]] = DEFAULT_SYNONYMS
) -> DataFrame:
    """Rename the columns of a table to their standard names; data is untouched."""
    return df.toDF(*standard_names(df.columns, synonyms))
