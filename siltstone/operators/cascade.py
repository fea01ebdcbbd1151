"""Cascading deletes over a graph of foreign keys.

Removals start from given rows and spread from parents to children. Tables are visited parents first, each once: the keys
of the removed parents are written, and one pass over the child's rows marks those that refer to any of them, whatever
the number of its foreign keys. Tables that refer to themselves or to each other in a circle are settled together in
semi-naive rounds, in which only the rows found last look for further ones.

What is joined to a child is the removed part of its parents' keys, distinct, so that a parent with a large share of the
children is one row there: broadcast where it was measured to be small, else a join whose large side adaptive execution
splits. Only the columns that foreign keys name are written; the rows themselves are not moved.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.names import free_names, quote_name
from siltstone.operators.joins import lookup_join
from siltstone.session import Settled, settle

CASCADE, SET_NULL, NO_ACTION = "cascade", "set null", "no action"


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``child`` hold ``references`` of ``parent``. ``when`` is a condition on the child's row under which
    the key applies, for columns that refer to another table by row. A NULL in any of the columns refers to nothing."""

    child: str
    columns: tuple[str, ...]
    parent: str
    references: tuple[str, ...]
    when: str | None = None
    on_delete: str = CASCADE

    def __post_init__(self):
        if len(self.columns) != len(self.references) or not self.columns:
            raise ValueError(f"{self}: as many columns as references, at least one")
        if self.on_delete not in (CASCADE, SET_NULL, NO_ACTION):
            raise ValueError(f"unknown action {self.on_delete}")


@dataclass(frozen=True)
class Removal:
    """``kept`` and ``removed`` rows of every table, and ``blocking``: for each key that cascades nowhere, the rows kept
    that refer to a removed one."""

    kept: dict[str, DataFrame]
    removed: dict[str, DataFrame]
    blocking: dict[ForeignKey, DataFrame] = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """``(table_name, removed_rows, kept_rows)``."""
        rows = []
        for name in self.kept:
            both = (self.kept[name].select(F.lit(0).alias("gone"))
                    .unionByName(self.removed[name].select(F.lit(1).alias("gone"))))
            rows.append(both.agg(F.coalesce(F.sum("gone"), F.lit(0)).cast("bigint").alias("removed_rows"),
                                 F.coalesce(F.sum(1 - F.col("gone")), F.lit(0)).cast("bigint").alias("kept_rows"))
                        .select(F.lit(name).alias("table_name"), "removed_rows", "kept_rows"))
        return reduce(DataFrame.unionByName, rows)


class Blocked(ValueError):
    """Rows that stay refer to rows that go, by a key that forbids it."""


def components(names: list[str], keys: list[ForeignKey]) -> list[list[str]]:
    """Tables grouped so that those that refer to each other in a circle are together, parents before children."""
    below: dict[str, set[str]] = {n: set() for n in names}
    for key in keys:
        if key.on_delete == CASCADE:
            below[key.parent].add(key.child)

    def reach(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for nxt in below[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return seen

    reached = {n: reach(n) for n in names}
    groups, done = [], set()
    # A table reaches all that its children reach, so that more reached tables come first.
    for name in sorted(names, key=lambda n: -len(reached[n] | {n})):
        if name not in done:
            circle = [n for n in names if n == name or (n in reached[name] and name in reached[n])]
            groups.append(circle)
            done.update(circle)
    return groups


def _when(key: ForeignKey) -> Column:
    return F.coalesce(F.expr(key.when), F.lit(False)) if key.when else F.lit(True)


def _refers(rows: DataFrame, key: ForeignKey, gone: Settled, mark: str) -> DataFrame:
    """``rows`` with the Boolean ``mark``: does the row refer, by ``key``, to one of ``gone(references)``?"""
    targets = free_names(rows, *(f"ref{i}" for i in range(len(key.columns))))
    flag, = free_names(rows, "hit")
    # A key that does not apply is looked up as NULL, which no parent has.
    named = rows.withColumns({t: F.when(_when(key), F.col(quote_name(c)))
                              for t, c in zip(targets, key.columns, strict=True)})
    parents = gone.narrowed(gone.frame.select(*[F.col(quote_name(r)).alias(t)
                                                for r, t in zip(key.references, targets, strict=True)],
                                              F.lit(True).alias(flag)))
    joined = lookup_join(named, parents, list(targets), "left")
    return joined.withColumn(mark, F.coalesce(F.col(flag), F.lit(False))).drop(flag, *targets)


def _any(marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(m) for m in marks], F.lit(False))


def _keys_of(rows: DataFrame, columns: tuple[str, ...], label: str) -> Settled:
    """The distinct values, none of them NULL, of the columns."""
    present = reduce(lambda a, b: a & b, [F.col(quote_name(c)).isNotNull() for c in columns])
    return settle(rows.where(present).select(*[F.col(quote_name(c)) for c in columns]).distinct(), label)


def cascade(tables: dict[str, DataFrame], keys: list[ForeignKey], removed: dict[str, Column | str],
            strict: bool = True) -> Removal:
    """Remove the rows for which the condition in ``removed`` holds, and all that refer to removed rows.

    Keys that cascade take their children along, ``set null`` empties the referring columns of rows that stay, and
    ``no action`` fails if a row that stays refers to one that goes; ``strict=False`` lists these rows in ``blocking``.
    A condition that is NULL for a row does not remove it. The references of a key need not be unique.
    """
    for key in keys:
        if key.child not in tables or key.parent not in tables:
            raise LookupError(f"{key.child} -> {key.parent}: unknown table")
    start = {name: F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for name, c in removed.items()}
    spread = [k for k in keys if k.on_delete == CASCADE]
    marked: dict[str, DataFrame] = {}
    names: dict[str, str] = {}
    gone: dict[tuple[str, tuple[str, ...]], Settled] = {}

    def gone_keys(table: str, columns: tuple[str, ...]) -> Settled:
        if (table, columns) not in gone:
            rows = marked[table].where(F.col(names[table]))
            gone[table, columns] = _keys_of(rows, columns, "removed-keys")
        return gone[table, columns]

    for group in components(list(tables), keys):
        for name in group:
            rows, (total, *_) = tables[name], free_names(tables[name], "gone")
            rows, marks = rows.withColumn(total, start.get(name, F.lit(False))), [total]
            for key in spread:
                if key.child == name and key.parent not in group:
                    mark, = free_names(rows, "mark")
                    rows = _refers(rows, key, gone_keys(key.parent, key.references), mark)
                    marks.append(mark)
            marked[name] = rows.withColumn(total, _any(marks)).drop(*marks[1:])
            names[name] = total
        inside = [k for k in spread if k.child in group and k.parent in group]
        if inside:
            found = _circle(group, inside, marked, names)
            for name in group:
                entries = {k.references for k in inside if k.parent == name}
                gone.update({(name, columns): found[name, columns] for columns in entries})
            for name in group:
                rows, marks = marked[name], [names[name]]
                for key in inside:
                    if key.child == name:
                        mark, = free_names(rows, "mark")
                        rows = _refers(rows, key, gone[key.parent, key.references], mark)
                        marks.append(mark)
                marked[name] = rows.withColumn(names[name], _any(marks)).drop(*marks[1:])

    kept = {n: marked[n].where(~F.col(names[n])).drop(names[n]) for n in tables}
    lost = {n: marked[n].where(F.col(names[n])).drop(names[n]) for n in tables}
    blocking = {}
    for key in keys:
        if key.on_delete == CASCADE:
            continue
        mark, = free_names(kept[key.child], "mark")
        rows = _refers(kept[key.child], key, gone_keys(key.parent, key.references), mark)
        if key.on_delete == SET_NULL:
            emptied = {c: F.when(~F.col(mark), F.col(quote_name(c))) for c in key.columns}
            kept[key.child] = rows.withColumns(emptied).drop(mark)
        else:
            blocking[key] = rows.where(F.col(mark)).drop(mark)
    if strict:
        for key, rows in blocking.items():
            if not rows.isEmpty():
                raise Blocked(f"rows of {key.child} still refer to removed rows of {key.parent}")
    return Removal({n: kept[n].select(*[F.col(quote_name(c)) for c in tables[n].columns]) for n in tables},
                   {n: lost[n].select(*[F.col(quote_name(c)) for c in tables[n].columns]) for n in tables}, blocking)


def _circle(group: list[str], inside: list[ForeignKey], marked: dict[str, DataFrame],
            names: dict[str, str]) -> dict[tuple[str, tuple[str, ...]], Settled]:
    """Removed keys of tables that refer to themselves or to each other, by rounds.

    A round reads, for each key, the child's columns that keys of the circle name, and finds the rows that refer to keys
    removed in the last round. It ends when no key is new, so that circles of rows end too.
    """
    wanted = {(k.parent, k.references) for k in inside}
    needed = {n: sorted({c for k in inside if k.child == n for c in k.columns}
                        | {c for t, columns in wanted if t == n for c in columns}) for n in group}
    # Conditions of keys read other columns too, so these are kept where there is one.
    conditional = {k.child for k in inside if k.when}
    links = {n: marked[n] if n in conditional else
             marked[n].select(*[F.col(quote_name(c)) for c in needed[n]], F.col(names[n])) for n in group}
    stored = {n: settle(links[n], "circle").frame for n in group}
    known = {(t, columns): _keys_of(stored[t].where(F.col(names[t])), columns, "circle-keys") for t, columns in wanted}
    last = dict(known)
    scans = dict.fromkeys(known, 1)
    while any(s.rows for s in last.values()):
        found: dict[tuple[str, tuple[str, ...]], list[DataFrame]] = {w: [] for w in wanted}
        for key in inside:
            front = last[key.parent, key.references]
            if not front.rows:
                continue
            rows = stored[key.child]
            mark, = free_names(rows, "mark")
            hit = _refers(rows, key, front, mark).where(F.col(mark))
            for table, columns in wanted:
                if table == key.child:
                    found[table, columns].append(hit.select(*[F.col(quote_name(c)) for c in columns]))
        for entry, frames in found.items():
            if not frames:
                last[entry] = Settled(known[entry].frame.limit(0), 0, 0)
                continue
            every = _keys_of(reduce(DataFrame.unionByName, frames), entry[1], "circle-found")
            fresh = settle(lookup_join(every.frame, known[entry], list(entry[1]), "left_anti"), "circle-round")
            last[entry] = fresh
            if fresh.rows:
                both = known[entry].frame.unionByName(fresh.frame)
                scans[entry] += 1
                known[entry] = Settled(both, known[entry].rows + fresh.rows, known[entry].size + fresh.size)
                if scans[entry] > 4:
                    known[entry], scans[entry] = settle(both, "circle-keys"), 1
    return known
