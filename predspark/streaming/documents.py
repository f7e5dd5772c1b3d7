"""Decide an expression over JSON documents that arrive event by event, as early as their values allow.

An event is a row (doc_id, seq, kind, text) with kind one of: begin_object, end_object, begin_array, end_array, key,
part (of a string, more follows), string (its last or only part), number (a whole token), number_too_long, true, false,
null, end (of the document).  Only cells that the program demands are kept; the rest is counted past, so the state of a
document is bounded by the program, not by the document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from predspark.errors import CheckProblem, EvaluationError, Pending, Problem
from predspark.functions import durations
from predspark.operators.environment import Program
from predspark.plans.ast import Select, Span, walk
from predspark.plans.evaluate import ABSENT, evaluate
from predspark.shipping import ship_package
from predspark.sources.values import bind
from predspark.types import BOOL, DURATION, LEAST_INT, MOST_INT, NUM, STR, MapOf, Record, Type

#: The number tokens of JSON; an integer out of range, or another token, is an error.
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
#: Characters of text that the cells of a document hold together.
MOST_TEXT = 64 * 1024


def shape_of(program: Program, root: str) -> set[tuple]:
    """The demanded paths below root; a program that reads a whole collection, or a value that is no scalar, is
    refused."""

    def refuse(why: str):
        raise CheckProblem(program.source, [Problem(why, 0, len(program.source))])

    if any(p[0] == root for p in program.demand.whole):
        refuse(f"{root} arrives piece by piece and cannot be iterated")
    out = {p[1:] for p in program.demand.paths if p[0] == root}
    if () in out:
        refuse(f"{root} is read as a whole")
    tests = {(n.field,) for n in walk(program.tree) if isinstance(n, Select) and n.test}
    for path in out:
        t = type_at(program.env.roots[root].type, path)
        if t not in (BOOL, NUM, STR, DURATION) and not (path[-1:] in tests or isinstance(t, (Record, MapOf)) and len(path)):
            refuse(f"{'.'.join(map(str, path))} is no scalar")
    return out


def type_at(t: Type, path: tuple) -> Type | None:
    for key in path:
        if isinstance(t, Record):
            f = t.get(key)
            t = f.type if f else None
        else:
            t = t.value if isinstance(t, MapOf) else None
    return t


class Document:
    """What is known of one document: cells, keys that were seen, objects that are closed."""

    def __init__(self, root: Type, wanted: set[tuple], state: dict[str, Any] | None = None) -> None:
        self.root, self.wanted = root, wanted
        self.near = {p[:n] for p in wanted for n in range(len(p) + 1)}
        s = state or {}
        self.cells: dict[tuple, Any] = {tuple(p): v for p, v in s.get("cells", [])}
        self.seen = {tuple(p) for p in s.get("seen", [])}
        self.closed = {tuple(p) for p in s.get("closed", [])}
        self.failed = {tuple(p) for p in s.get("failed", [])}
        self.path: list = s.get("path", [])
        self.skip, self.text, self.held, self.ended = s.get("skip", 0), s.get("text"), s.get("held", 0), s.get("ended", False)
        self.again = s.get("again", False)

    def state(self) -> dict[str, Any]:
        return {
            "cells": [[list(p), v] for p, v in self.cells.items()],
            **{k: [list(p) for p in getattr(self, k)] for k in ("seen", "closed", "failed")},
            **{k: getattr(self, k) for k in ("path", "skip", "text", "held", "ended", "again")},
        }

    def moved(self) -> bool:
        """Whether cells, keys, closed objects or failures have changed since this was asked last; nothing else can
        settle a program."""
        now = (len(self.cells), len(self.seen), len(self.closed), len(self.failed), self.ended)
        out, self._last = now != getattr(self, "_last", None), now
        return out

    def push(self, kind: str, text: str | None) -> None:
        if kind == "end":
            self.ended = True
        elif self.skip:
            self.skip += {"begin_object": 1, "begin_array": 1, "end_object": -1, "end_array": -1}.get(kind, 0)
            if not self.skip:
                self.after()
        elif kind == "key":
            here = (*self.path, text)
            self.again = here in self.seen
            if tuple(self.path) in self.near:
                self.seen.add(here)
            self.path.append(text)
        elif kind == "end_object":
            self.closed.add(tuple(self.path))
            self.after()
        elif kind == "part":
            self.keep(text)
        else:
            here = tuple(self.path)
            wanted = here in self.near and not self.again
            if kind in ("begin_object", "begin_array"):
                t = type_at(self.root, here)
                if kind == "begin_object" and wanted and isinstance(t, (Record, MapOf)):
                    return
                if wanted:
                    self.failed.add(here)
                self.skip = 1
                return
            if wanted:
                self.settle(here, kind, text)
            self.text = None
            self.after()

    def keep(self, text: str | None) -> None:
        if tuple(self.path) in self.wanted and not self.again:
            self.held += len(text or "")
            self.text = (self.text or "") + (text or "") if self.held <= MOST_TEXT else self.text or ""

    def settle(self, here: tuple, kind: str, text: str | None) -> None:
        t = type_at(self.root, here)
        if kind == "string" and t in (STR, DURATION):
            self.keep(text)
            if self.held <= MOST_TEXT:
                if t == STR:
                    self.cells[here] = self.text
                    return
                if (d := durations.parse(self.text)) is not None:
                    self.cells[here] = {"ns": d.ns}
                    return
        elif kind == "number" and t == NUM:
            if NUMBER.fullmatch(text or ""):
                n = int(text) if text.lstrip("-").isdigit() else float(text)
                if isinstance(n, float) or LEAST_INT <= n <= MOST_INT:
                    self.cells[here] = n
                    return
        elif kind in ("true", "false") and t == BOOL:
            self.cells[here] = kind == "true"
            return
        self.failed.add(here)

    def after(self) -> None:
        """A value is over: back to its object."""
        if self.path:
            self.path.pop()
        self.again = False


class View:
    """A record of a document, as evaluation sees it."""

    def __init__(self, doc: Document, path: tuple) -> None:
        self.doc, self.path = doc, path

    def whole(self) -> bool:
        return self.doc.ended or self.path in self.doc.closed

    def present(self, key: Any) -> bool:
        here = (*self.path, key)
        if self.path in self.doc.failed:
            raise EvaluationError("another kind of value")
        if here in self.doc.seen:
            return True
        if not self.whole():
            raise Pending
        return False

    def get(self, key: Any, default: Any = ABSENT) -> Any:
        here, doc = (*self.path, key), self.doc
        if here in doc.cells:
            v = doc.cells[here]
            return Span(v["ns"]) if isinstance(v, dict) else v
        if here in doc.failed or self.path in doc.failed:
            raise EvaluationError("another kind of value")
        if here in doc.seen and isinstance(type_at(doc.root, here), (Record, MapOf)):
            return View(doc, here)
        if here in doc.seen and not doc.ended or not self.whole():
            raise Pending
        return default


def verdict(program: Program, root: str, doc: Document, others: dict[str, Any] | None = None) -> str | None:
    """'true', 'false' or 'error' as soon as it is settled, else None."""
    hosts = {k: h.python for k, h in program.env.hosts.items() if h.python}
    try:
        return "true" if evaluate(program.tree, {**(others or {}), root: View(doc, ())}, hosts) else "false"
    except EvaluationError:
        return "error"
    except Pending:
        return "error" if doc.ended else None


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("verdict", T.StringType())])


def decide_documents(events: DataFrame, program: Program, root: str, bound: Mapping[str, Any] | None = None, silence_ms: int | None = None) -> DataFrame:
    """(doc_id, verdict) for each document, once, in append mode when events is a stream.  Events of a document are
    taken in the order of seq within a micro-batch, and micro-batches in the order they come.

    bound: values of the program's other roots, the same for every document; a root with neither is refused.
    silence_ms: a streamed document that no event comes for in so long ends there, and its state goes; without it a
    document that never ends is kept."""
    wanted, kind = shape_of(program, root), program.env.roots[root].type
    others = {k: bind(v, program.env.roots[k].type, k, program.env.limits) for k, v in (bound or {}).items()}
    if missing := [r for r in program.demand.roots() if r != root and r not in others]:
        raise CheckProblem(program.source, [Problem(f"{', '.join(missing)}: neither the document nor bound", 0, len(program.source))])
    ship_package(events.sparkSession)

    def advance(rows: pd.DataFrame, doc: Document) -> str | None:
        for event, text in rows.sort_values("seq")[["kind", "text"]].itertuples(index=False):
            doc.push(event, text if isinstance(text, str) else None)
            if event != "part" and (out := verdict(program, root, doc, others)) is not None:
                return out
        return None

    columns = events.select(events["doc_id"].cast("long").alias("doc_id"), "seq", "kind", "text")
    if not events.isStreaming:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, doc, done = None, None, []
            for rows in batches:
                for doc_id, event, text in zip(rows["doc_id"].tolist(), rows["kind"].tolist(), rows["text"].tolist(), strict=True):
                    if doc is None or doc_id != last:
                        last, doc, open_ = doc_id, Document(kind, wanted), True
                    if not open_:
                        continue
                    doc.push(event, text if isinstance(text, str) else None)
                    if event != "part" and doc.moved() and (out := verdict(program, root, doc, others)) is not None:
                        done.append((doc_id, out))
                        open_ = False
                yield pd.DataFrame({"doc_id": [d for d, _ in done], "verdict": [v for _, v in done]}, dtype=object)
                done = []

        return columns.where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInPandas(whole, OUT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = pd.DataFrame({"seq": [0], "kind": ["end"], "text": [None]})
        else:
            rows = pd.concat(list(batches))
        last = (rows["kind"] == "end").any()
        held = json.loads(state.get[0]) if state.exists else None
        if held == "decided":
            if last:
                state.remove()
            return
        doc = Document(kind, wanted, held)
        out = advance(rows, doc)
        if last:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps("decided" if out else doc.state()),))
            if silence_ms is not None:
                state.setTimeoutDuration(silence_ms)
        if out:
            yield pd.DataFrame({"doc_id": [key[0]], "verdict": [out]})

    return columns.groupBy("doc_id").applyInPandasWithState(step, OUT, T.StructType([T.StructField("s", T.StringType())]), "append", GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


__all__ = ["Document", "decide_documents", "verdict"]
