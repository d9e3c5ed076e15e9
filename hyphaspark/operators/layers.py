"""Feature layers: anything that adds feature columns to cells, composed in order."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FeatureLayer(Protocol):
    """Gives a table of features by cell key: ``attach(cells)`` returns the key and its columns."""

    name: str

    def attach(self, cells: DataFrame) -> DataFrame | None: ...


def compose(cells: DataFrame, layers: list[FeatureLayer], key: str, base: str | None = None) -> tuple[DataFrame, list[str]]:
    """Cells with the columns of all layers, and the names of the active ones. A later layer overrides
    an earlier one wherever it has a value; a layer without data is skipped; cells that the ``base``
    layer does not cover have no record. Layers are as long as the cells, so neither is sent to all executors."""
    out, active = cells, []
    for layer in layers:
        made = layer.attach(cells)
        if made is None:
            continue
        active.append(layer.name)
        columns = [c for c in made.columns if c != key]
        renamed = made.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
        out = out.join(renamed.hint("merge"), key, "inner" if layer.name == base else "left")
        known = set(out.columns)
        out = out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in known else F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    return out, active
