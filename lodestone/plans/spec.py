"""The structured query: plain data, by column name, that SQL text parses to and prints from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

OPS = ("=", "<>", "<", "<=", ">", ">=", "LIKE", "BETWEEN", "IS NULL", "IS NOT NULL")
RANGE_OPS = frozenset(OPS[:6]) | {"BETWEEN"}
#: Metric kinds and their short names, fixed by the dialect.
METRICS = {
    "COUNT": "COUNT", "COUNT_ALL": "COUNT", "COUNT_DISTINCT": "CNTD", "SUM": "SUM", "AVG": "AVG", "MIN": "MIN", "MAX": "MAX", "STD": "STD", "STDP": "STDP", "VAR": "VAR", "CV": "CV",
    "RANGE": "RANGE", "MED": "MED", "P90": "P90", "P95": "P95", "P99": "P99", "IQR": "IQR", "MODE": "MODE", "NULLS": "NULLS",
}
GROUP_MODES = ("flat", "rollup", "cube", "pivot")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None
    upper: object = None
    link: str = "AND"  # how it joins the clause before it


@dataclass(frozen=True)
class Sort:
    column: str  # a column, an alias or a metric's name
    descending: bool = False


@dataclass(frozen=True)
class Metric:
    kind: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{METRICS[self.kind]}({self.column or '*'})"


@dataclass(frozen=True)
class QuerySpec:
    select: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    group_mode: str = "flat"
    metrics: tuple[Metric, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    order_key: str | None = field(default=None, compare=False)  # a unique column that stands for row order

    @property
    def aggregates(self) -> bool:
        return bool(self.group_by or self.metrics)


def or_groups(filters: tuple[Filter, ...]) -> list[list[Filter]]:
    """AND binds tighter than OR: the clauses as an OR of ANDs."""
    groups: list[list[Filter]] = []
    for f in filters:
        if f.link == "OR" or not groups:
            groups.append([])
        groups[-1].append(f)
    return groups


def toggle_sort(q: QuerySpec, column: str, add: bool = False) -> QuerySpec:
    """ASC, then DESC, then none; `add` keeps the other keys."""
    now = next((s for s in q.sort if s.column == column), None)
    new = () if now and now.descending else (Sort(column, bool(now)),)
    if not add:
        return replace(q, sort=new)
    kept = []
    for s in q.sort:
        kept += new if s.column == column else [s]
    return replace(q, sort=tuple(kept) if now else (*kept, *new))


def display_order(columns: list[str], pinned: tuple[str, ...] = (), hidden: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> list[str]:
    """Pinned columns first, hidden ones dropped; hidden columns can still be queried."""
    base = [c for c in order if c in columns] + [c for c in columns if c not in order]
    shown = [c for c in base if c not in hidden]
    return [c for c in pinned if c in shown] + [c for c in shown if c not in pinned]


def scope_to(q: QuerySpec, f: Filter) -> QuerySpec:
    """Narrow to a clicked bar or value: ranges and equalities on its column give way, in every OR branch."""
    groups = or_groups(q.filters) or [[]]
    out: list[Filter] = []
    for i, g in enumerate(groups):
        kept = [c for c in g if not (c.column == f.column and (c.op in RANGE_OPS or c.op.startswith("IS ")))] + [f]
        out += [replace(c, link="AND" if j or not i else "OR") for j, c in enumerate(kept)]
    return replace(q, filters=tuple(out))
