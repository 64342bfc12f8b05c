"""The stateful processor of the circulation stream.

It runs in the Python workers, which need not have this package: the module is sent to them by value (see
`circulation.py`), so it takes only plain values from the rest of the package.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lendframe.operators.jobs import (
    ALREADY_BORROWED,
    LOAN_NOT_FOUND,
    MAX_RENEWALS_REACHED,
    MEMBER_NOT_ACTIVE,
    MEMBER_NOT_FOUND,
    NO_COPIES,
)
from lendframe.schema import FINE_PER_DAY, MAX_RENEWALS


class BookDesk(StatefulProcessor):
    """State of one book: copies left on the shelf, and due date and renewals of each member's open loan."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.copies = handle.getValueState("copies", "left int")
        self.loans = handle.getMapState("loans", "member_id long", "due_date date, renewed int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for loan in initialState.itertuples(index=False):
            self.loans.updateValue((loan.member_id,), (loan.due_date, int(loan.renewed_count)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ts", "event_id"])
        stored = self.copies.get() if self.copies.exists() else None
        self.left = int(stored[0]) if stored else int(events["copies"].iloc[0])
        decided = [self._serve(event) for event in events.itertuples(index=False)]
        self.copies.update((self.left,))
        out = events[["event_id", "book_id", "member_id", "action"]].reset_index(drop=True)
        rest = pd.DataFrame(decided, columns=["reason", "due_date", "fine"], dtype=object)
        out.insert(4, "accepted", rest["reason"].isna())
        yield pd.concat([out, rest], axis=1)

    def _serve(self, event) -> tuple:
        """(reason, due date, fine) of one event; reason None means it was accepted."""
        member = (event.member_id,)
        held = self.loans.getValue(member) if self.loans.containsKey(member) else None
        if event.action == "issue":
            reason = self._refusal(event, held)
            if reason:
                return reason, None, None
            due = event.day + timedelta(days=int(event.days))
            self.left -= 1
            self.loans.updateValue(member, (due, 0))
            return None, due, None
        if held is None:
            return LOAN_NOT_FOUND, None, None
        due, renewed = held[0], int(held[1])
        if event.action == "return":
            self.left += 1
            self.loans.removeKey(member)
            late = (event.day - due).days
            return None, due, FINE_PER_DAY * late if late > 0 else None
        if renewed >= MAX_RENEWALS:
            return MAX_RENEWALS_REACHED, due, None
        due += timedelta(days=int(event.days))
        self.loans.updateValue(member, (due, renewed + 1))
        return None, due, None

    def _refusal(self, event, held) -> str | None:
        if event.status is None:
            return MEMBER_NOT_FOUND
        if event.status != "active":
            return MEMBER_NOT_ACTIVE
        if held is not None:
            return ALREADY_BORROWED
        return NO_COPIES if self.left <= 0 else None

    def close(self) -> None:
        pass
