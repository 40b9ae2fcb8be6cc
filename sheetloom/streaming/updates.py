"""Update queues and dirty boxes of viewers, over batches and streams."""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks and boxes that a viewer keeps.
MOST_TASKS, MOST_BOXES = 1000, 64
RESULT = "seq long, op string, entity long, priority int, waited double, skipped int, pending int, regions array<array<double>>"
FIELDS = ["seq", "op", "at", "entity", "priority", "lasts", "x0", "y0", "x1", "y1"]


def _meet(a, b) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def _around(a, b) -> list[float]:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


class Updater:
    """A viewer's waiting tasks and dirty boxes.

    A mark adds a box and a task; a full queue first loses its least urgent task, the newest of these. More boxes than most_boxes
    become one. The next task is the most urgent one, the oldest of these, that has not lasted longer than it may; those
    that have are skipped. A view gives the boxes that meet it, joined where they meet each other, also by steps."""

    def __init__(self, most_tasks: int = MOST_TASKS, most_boxes: int = MOST_BOXES, kept: str | None = None) -> None:
        self.most_tasks, self.most_boxes = most_tasks, most_boxes
        self.tasks, self.boxes = json.loads(kept) if kept else ([], [])

    def kept(self) -> str:
        return json.dumps([self.tasks, self.boxes])

    def mark(self, seq, at, entity, priority, lasts, box) -> None:
        if box is not None:
            self.boxes.append(box)
            if len(self.boxes) > self.most_boxes:
                whole = self.boxes[0]
                for b in self.boxes[1:]:
                    whole = _around(whole, b)
                self.boxes = [whole]
        if len(self.tasks) >= self.most_tasks:
            self.tasks.remove(max(self.tasks))
            heapq.heapify(self.tasks)
        heapq.heappush(self.tasks, [priority, seq, at, entity, lasts])

    def next(self, at):
        """(entity, priority, waited, skipped); entity is null where nothing waits."""
        skipped = 0
        while self.tasks:
            priority, _, since, entity, lasts = heapq.heappop(self.tasks)
            if lasts is None or at - since <= lasts:
                return entity, priority, at - since, skipped
            skipped += 1
        return None, None, None, skipped

    def view(self, window) -> list[list[float]]:
        out = []
        for box in (b for b in self.boxes if _meet(b, window)):
            met = True
            while met:
                met = [b for b in out if _meet(b, box)]
                out = [b for b in out if not _meet(b, box)]
                for b in met:
                    box = _around(box, b)
            out.append(box)
        return sorted(out)

    def see(self, seq, op, at, entity, priority, lasts, x0, y0, x1, y1):
        """A result row for next and view, else None."""
        box = None if any(v is None for v in (x0, y0, x1, y1)) else [x0, y0, x1, y1]
        if op == "mark" and priority is not None:
            self.mark(seq, at, entity, priority, lasts, box)
        elif op == "next":
            entity, priority, waited, skipped = self.next(at)
            return seq, op, entity, priority, waited, skipped, len(self.tasks), None
        elif op == "view" and box is not None:
            return seq, op, None, None, None, 0, len(self.tasks), self.view(box)
        elif op == "clear":
            self.boxes = []
        return None


def _rows(pdf: pd.DataFrame):
    """Rows of FIELDS with None for missing values and whole numbers as such."""
    whole = {"seq", "entity", "priority"}
    columns = [[None if pd.isna(v) else v if c == "op" else int(v) if c in whole else float(v) for v in pdf[c]] for c in FIELDS]
    return zip(*columns, strict=True)


def _frame(key: str, out: list) -> pd.DataFrame:
    f = pd.DataFrame(out, columns=[key, "seq", "op", "entity", "priority", "waited", "skipped", "pending", "regions"])
    return f.astype({"entity": "Int64", "priority": "Int32", "waited": "Float64"})


def _schema(events: DataFrame, key: str) -> str:
    return f"`{key}` {events.schema[key].dataType.simpleString()}, {RESULT}"


def update_results(events: DataFrame, key: str, most_tasks: int = MOST_TASKS, most_boxes: int = MOST_BOXES) -> DataFrame:
    """(key, seq, op, entity, priority, waited, skipped, pending, regions): a row for every next and view of events
    (key, seq, op, at, entity, priority, lasts, x0, y0, x1, y1), as Updater has them, in the order of at and seq.

    op is mark, next, view or clear; others, marks without a priority and views without a box do nothing. at and lasts are seconds,
    lasts null for tasks that do not expire. seq is unique within a key. Spark sorts a key's events and they stream by one bounded
    state, so that a key of any size fits."""

    def work(frames):
        now, updater = None, None
        for pdf in frames:
            out = []
            for k, row in zip(pdf["k"], _rows(pdf), strict=True):
                if updater is None or k != now:
                    now, updater = k, Updater(most_tasks, most_boxes)
                result = updater.see(*row)
                if result is not None:
                    out.append((k, *result))
            yield _frame(key, out)

    rows = events.filter(F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull()).select(F.col(key).alias("k"), *FIELDS)
    return rows.repartition("k").sortWithinPartitions("k", "at", "seq").mapInPandas(work, _schema(events, key))


def update_stream(events: DataFrame, key: str, most_tasks: int = MOST_TASKS, most_boxes: int = MOST_BOXES) -> DataFrame:
    """The same as a stateful stream: a key's queue and boxes are kept between batches; within a batch events go by at and seq."""

    def step(k, frames, state):
        updater = Updater(most_tasks, most_boxes, state.get[0] if state.exists else None)
        out = []
        for row in sorted((r for pdf in frames for r in _rows(pdf)), key=lambda r: (r[2], r[0])):
            result = updater.see(*row)
            if result is not None:
                out.append((k[0], *result))
        state.update((updater.kept(),))
        yield _frame(key, out)

    rows = events.filter(F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull()).select(key, *FIELDS)
    return rows.groupBy(key).applyInPandasWithState(step, _schema(events, key), "kept string", "append", "NoTimeout")
