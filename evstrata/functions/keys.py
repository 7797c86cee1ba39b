"""Hierarchical keys: a run holds sub-runs, a sub-run holds events; an ID is the triple of numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN, SUBRUN, EVENT = "run", "subrun", "event"
KEY = (RUN, SUBRUN, EVENT)
#: SQL form of three numbers with colons, blanks around each allowed.
TRIPLE = r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+)\s*$"


@dataclass(frozen=True, order=True)
class EventID:
    run: int
    subrun: int
    event: int

    @staticmethod
    def parse(text: str) -> EventID | None:
        """``run:subrun:event``; an empty text means from the beginning, anything else is an error."""
        if not text.strip():
            return None
        found = re.match(TRIPLE, text)
        if not found:
            raise ValueError(f"not a run:subrun:event triple: {text!r}")
        return EventID(*map(int, found.groups()))

    def next(self) -> EventID:
        return EventID(self.run, self.subrun, self.event + 1)

    def struct(self) -> Column:
        return id_struct(F.lit(self.run), F.lit(self.subrun), F.lit(self.event))


def id_struct(run: Column | str = RUN, subrun: Column | str = SUBRUN, event: Column | str = EVENT) -> Column:
    """The comparable form of an ID."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_column(run).cast("bigint").alias(RUN), as_column(subrun).cast("bigint").alias(SUBRUN), as_column(event).cast("bigint").alias(EVENT))


def parsed_id(text: Column | str) -> tuple[Column, Column, Column]:
    """Run, sub-run and event of a textual ID, null where it is malformed."""
    return tuple(F.expr(f"try_cast(nullif(regexp_extract({text}, '{TRIPLE.replace(chr(92), chr(92) * 2)}', {i}), '') as bigint)") for i in (1, 2, 3))
