"""Replay of edit events with provenance: who wrote each character of a document.

Sequential state per session, so a session is one group; sessions are many and
each is as long as its own document's history. Offsets in events count UTF-16
units, as the editor's do; results count code points.

Rules. The initial document is unknown. Each insertion of the api is a suggestion
with an origin of its own, label 1. A single typed character of the user is 0, a
longer insertion may be pasted: unknown. The user edits a suggestion by deleting
characters of it, by typing between two characters of the same one, or beside a
suggestion or text that an edit has touched before; what lies between two
different suggestions is no edit. An edited suggestion is unknown as a whole, and
so is all that the editing event inserts; that text stays bound to the edit, so
later typing beside it is unknown too. Offsets past the end, or within a surrogate
pair, and events of unknown sources are errors.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

MASKED = -100
KINDS = ("text-insert", "text-delete")


@dataclass
class Char:
    c: str
    label: int | None = None
    origin: int | None = None  # the api event it came with
    edit: int | None = None  # the suggestion whose edit it belongs to

    @property
    def width(self) -> int:
        return 2 if ord(self.c) > 0xFFFF else 1


def _advance(doc: list[Char], at: int, units: int) -> int:
    """The place `units` UTF-16 units after the character at `at`."""
    while units > 0:
        if at >= len(doc):
            raise ValueError("an offset lies past the document's end")
        units -= doc[at].width
        at += 1
    if units < 0:
        raise ValueError("an offset splits a surrogate pair")
    return at


def _edits(event: dict) -> list[dict]:
    """The changes of a text event; none for other events."""
    if event.get("eventName") not in KINDS:
        return []
    if event.get("eventSource") not in ("user", "api"):
        raise ValueError(f"the source of a text event is {event.get('eventSource')!r}")
    delta = event.get("textDelta")
    if not isinstance(delta, dict):
        raise ValueError("a text event has no delta")
    return delta.get("ops") or []


def _initial(events: list[dict]) -> str:
    found = [e for e in events if e.get("eventName") == "system-initialize"]
    if len(found) != 1 or not isinstance(found[0].get("currentDoc"), str):
        raise ValueError("a session has exactly one initial document")
    return found[0]["currentDoc"]


def _user_insert(doc: list[Char], at: int, spoiled: set[int]) -> set[int]:
    """The suggestions that typing at `at` edits."""
    sides = [x for x in (doc[at - 1] if at else None, doc[at] if at < len(doc) else None) if x]
    near = {y for x in sides for y in (x.origin, x.edit) if y is not None}
    within = len(sides) == 2 and sides[0].origin is not None and sides[0].origin == sides[1].origin
    return near if within or near & spoiled or any(x.edit is not None for x in sides) else set()


def replay_events(events: list[dict]) -> dict:
    """text, labels (None, 0, 1) and the number of events that edited suggestions. Events come in order."""
    doc = [Char(c) for c in _initial(events)]
    spoiled: set[int] = set()
    edited = 0
    for number, e in enumerate(events):
        user, origin = e.get("eventSource") == "user", int(e.get("eventNum") or number)
        units, touched, new = 0, set(), []
        for op in _edits(e):
            if op.get("retain"):
                units += int(op["retain"])
            elif op.get("delete"):
                at = _advance(doc, 0, units)
                end = _advance(doc, at, int(op["delete"]))
                if user:
                    gone = {x.origin for x in doc[at:end]} - {None}
                    spoiled |= gone
                    touched |= gone | {x.edit for x in doc[at:end]} - {None}
                del doc[at:end]
            elif op.get("insert"):
                if not isinstance(op["insert"], str):
                    raise ValueError("an insertion is no text")
                at = _advance(doc, 0, units)
                if user and (near := _user_insert(doc, at, spoiled)):
                    touched |= near
                    spoiled |= near & {x.origin for x in doc}
                label = 1 if not user else 0 if len(op["insert"]) == 1 else None
                own = [Char(c, label, None if user else origin, min(touched) if touched else None) for c in op["insert"]]
                doc[at:at] = own
                new += own
                units += sum(x.width for x in own)
        if touched:
            edited += 1
            for x in new:
                x.label, x.edit = None, min(touched)
        if e.get("currentCursor") is not None and not 0 <= int(e["currentCursor"]) <= sum(x.width for x in doc):
            raise ValueError("the cursor lies outside the document")
    labels = [None if x.origin in spoiled else x.label for x in doc]
    return {"text": "".join(x.c for x in doc), "labels": labels, "edited": edited}


def spans_of(labels: list[int | None]) -> list[tuple[int, int, int]]:
    """Runs of equal labels as (start, end, label); None is -100."""
    out: list[tuple[int, int, int]] = []
    for i, x in enumerate(labels):
        y = MASKED if x is None else x
        if out and out[-1][2] == y:
            out[-1] = (out[-1][0], i + 1, y)
        else:
            out.append((i, i + 1, y))
    return out


def replay_text(events: list[dict]) -> str:
    """The text alone, on UTF-16 units: an independent check of replay_events."""
    units = b""
    for e in events:
        if e["eventName"] == "system-initialize":
            units = (e.get("currentDoc") or "").encode("utf-16-le")
        at = 0
        for op in _edits(e):
            if op.get("retain"):
                at += 2 * op["retain"]
            elif op.get("delete"):
                units = units[:at] + units[at + 2 * op["delete"] :]
            elif op.get("insert"):
                new = op["insert"].encode("utf-16-le")
                units, at = units[:at] + new + units[at:], at + len(new)
    return units.decode("utf-16-le")


EVENTS = "session string, eventNum int, eventName string, eventSource string, currentDoc string, ops array<struct<retain:int,insert:string,delete:int>>"


def replay(df: DataFrame) -> DataFrame:
    """(session, text, spans, edited) from event rows of the schema EVENTS."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        events = [
            {"eventNum": r.eventNum, "eventName": r.eventName, "eventSource": r.eventSource, "currentDoc": r.currentDoc, "textDelta": {"ops": [dict(o) for o in r.ops] if r.ops is not None else []}}
            for r in pdf.sort_values("eventNum").itertuples()
        ]
        for e in events:
            for o in e["textDelta"]["ops"]:
                for k in ("retain", "delete"):
                    o[k] = int(o[k]) if o.get(k) is not None and o[k] == o[k] else 0
        x = replay_events(events)
        return pd.DataFrame([{"session": pdf["session"].iloc[0], "text": x["text"], "spans": [{"start": a, "end": b, "label": y} for a, b, y in spans_of(x["labels"])], "edited": x["edited"]}])

    return df.groupBy("session").applyInPandas(one, "session string, text string, spans array<struct<start:int,end:int,label:int>>, edited int")
