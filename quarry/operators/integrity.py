"""Integrity of tables: keys, references and checks stated once, what breaks them, and what a deletion takes with it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import staged


@dataclass(frozen=True)
class Unique:
    """No two rows share a key. Rows with a null in the key share none; where limits the rule to some rows."""

    name: str
    table: str
    key: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    """A row with a whole key has a parent of that key. With cascade it goes when the parent goes; otherwise
    it keeps the parent from going."""

    name: str
    table: str
    key: tuple[str, ...]
    parent: str
    parent_key: tuple[str, ...]
    cascade: bool = False


@dataclass(frozen=True)
class Check:
    """A condition on each row; null is no violation."""

    name: str
    table: str
    holds: str


Rule = Unique | Reference | Check


def _whole(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))


def _parents(parent: DataFrame, rule: Reference) -> DataFrame:
    return parent.select(*[F.col(p).alias(c) for p, c in zip(rule.parent_key, rule.key, strict=True)])


def violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, violations) of every rule: rows beyond the first of a key, rows without a parent, rows whose
    condition is false. All checks of a table are one scan; children are counted by key before they meet
    their parents, so that a parent of a third of all rows is one row of the join. Each key and reference reads its tables
    once: write tables that are dear to make before. The counts of a table's rules are written before the next table's
    turn: one plan of all rules would be more than a small driver holds."""
    by_table: dict[str, list[Rule]] = {}
    for rule in rules:
        by_table.setdefault(rule.table, []).append(rule)
    return reduce(DataFrame.unionByName, [staged(_violations_of(tables, own), f"violations-{name}") for name, own in by_table.items()])


def _violations_of(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """violations() of the rules of one table."""
    counted, checks = [], [r for r in rules if isinstance(r, Check)]
    for rule in rules:
        if isinstance(rule, Check):
            continue
        rows = _whole(tables[rule.table], rule.key)
        if isinstance(rule, Unique):
            rows = rows.where(rule.where)
        n = rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n"))
        if isinstance(rule, Unique):
            total = F.sum(F.col("n") - 1)
        else:
            n, total = n.join(_parents(tables[rule.parent], rule), list(rule.key), "left_anti"), F.sum("n")
        counted.append(n.agg(F.coalesce(total, F.lit(0)).cast("long").alias("violations")).select(F.lit(rule.name).alias("rule"), "violations"))
    if checks:
        row = tables[checks[0].table].agg(*[F.count_if(~F.expr(r.holds)).alias(f"n{i}") for i, r in enumerate(checks)])
        each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("violations")) for i, r in enumerate(checks)])).alias("c")
        counted.append(row.select(each).select("c.*"))
    return reduce(DataFrame.unionByName, counted)


def broken_rows(tables: dict[str, DataFrame], rule: Rule) -> DataFrame:
    """The rows that break a rule, for repair: all rows of a repeated key, those without a parent, or those
    whose condition is false."""
    rows = tables[rule.table]
    if isinstance(rule, Check):
        return rows.where(~F.expr(rule.holds))
    if isinstance(rule, Reference):
        return _whole(rows, rule.key).join(_parents(tables[rule.parent], rule), list(rule.key), "left_anti")
    rows = _whole(rows, rule.key).where(rule.where)
    twice = rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(twice, list(rule.key), "left_semi")


class Blocked(ValueError):
    """Rows that stay refer to rows that would go."""


@dataclass
class Deletion:
    """gone: the rows that go, by table (tables without any entry lose none). blocked: (rule, rows) of each
    reference without cascade into what goes, with the number of rows that stay and hold it back."""

    before: dict[str, DataFrame]
    keys: dict[str, tuple[str, ...]]
    gone: dict[str, DataFrame]
    blocked: DataFrame

    def after(self) -> dict[str, DataFrame]:
        """The tables without what goes. Raises Blocked, naming the rules, if a row holds it back."""
        held = [f"{r['rule']} ({r['rows']} rows)" for r in self.blocked.where("rows > 0").orderBy("rule").collect()]
        if held:
            raise Blocked(", ".join(held))
        return {name: _without(rows, self.gone.get(name), self.keys[name]) for name, rows in self.before.items()}


def _without(rows: DataFrame, gone: DataFrame | None, key: tuple[str, ...]) -> DataFrame:
    return rows if gone is None else rows.join(gone.select(*key), list(key), "left_anti")


def _parents_first(tables: dict[str, DataFrame], cascades: list[Reference]) -> list[str]:
    order, waiting = [], list(tables)
    while waiting:
        ready = [t for t in waiting if not any(r.table == t and r.parent in waiting and r.parent != t for r in cascades)]
        if not ready:
            raise ValueError(f"cascades of {', '.join(sorted(waiting))} form a ring")
        order += ready
        waiting = [t for t in waiting if t not in ready]
    return order


def delete(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], rules: list[Rule], roots: dict[str, DataFrame]) -> Deletion:
    """What goes with the rows of roots (keys of some tables): their children by cascading references, and
    theirs, table after table, parents first. Each table's part is written before its children meet it. A table
    that refers to itself is followed level by level, one round a level; rows in a ring go once."""
    cascades = [r for r in rules if isinstance(r, Reference) and r.cascade]
    gone: dict[str, DataFrame] = {}
    for name in _parents_first(tables, cascades):
        key, rows = keys[name], tables[name]
        found = [roots[name].select(*key)] if name in roots else []
        found += [rows.join(_parents(gone[r.parent], r), list(r.key), "left_semi").select(*key) for r in cascades if r.table == name and r.parent in gone and r.parent != name]
        if not found:
            continue
        level = staged(rows.join(reduce(DataFrame.unionByName, found), list(key), "left_semi"), f"gone-{name}")
        gone[name] = level
        for own in [r for r in cascades if r.table == name and r.parent == name]:
            level = gone[name]
            while True:
                more = rows.join(_parents(level, own), list(own.key), "left_semi")
                level = staged(_without(more, gone[name], key), f"gone-{name}")
                if level.isEmpty():
                    break
                gone[name] = gone[name].unionByName(level)
    counted = None
    for r in rules:
        if not isinstance(r, Reference) or r.cascade or r.parent not in gone:
            continue
        held = _without(tables[r.table].join(_parents(gone[r.parent], r), list(r.key), "left_semi"), gone.get(r.table), keys[r.table])
        one = held.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(r.name).alias("rule"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        spark = next(iter(tables.values())).sparkSession
        counted = spark.createDataFrame([], "rule string, rows long")
    return Deletion(tables, keys, gone, counted)
