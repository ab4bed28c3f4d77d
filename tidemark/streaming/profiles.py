"""Profiles kept as state per key: loaded from a table when the stream first starts, created at a key's first row where the
table has none, and from then on as the stream itself last left them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class Profiles(StatefulProcessor):
    """``fields`` are the row's columns after the key, ``names`` the profile's, ``defaults`` what a new or empty one has."""

    def __init__(self, fields: list[str], names: list[str], defaults: dict, schema: str, output: list[str]):
        self.fields, self.names, self.defaults = fields, names, defaults
        self.schema, self.output = schema, output

    def init(self, handle) -> None:
        self.profile = handle.getValueState("profile", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.profile.update(tuple(initialState[n] for n in self.names))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.profile.exists()
        have = tuple(self.profile.get()) if known else (None,) * len(self.names)
        full = tuple(self.defaults.get(n) if v is None else v for n, v in zip(self.names, have))
        if full != have or not known:
            self.profile.update(full)
        named = Row(*self.output)
        for row in rows:
            yield named(*key, *[row[f] for f in self.fields], *full, known)
            known = True

    def close(self) -> None:
        pass
