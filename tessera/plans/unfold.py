"""Graph patterns over mapped relations, unfolded into scans of the relations themselves.

No triple is built: a pattern is met by the rules whose predicate and templates can match; patterns that
share a subject become one scan; constants become conditions on columns, by inverting the template; a
variable stays a template over columns until it is shown, so that joins compare the columns. Catalyst
then sees scans with few columns and plain filters. Scans are made distinct, on their narrow columns,
only where the subject is no declared key.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import sizes
from tessera.operators import mapping
from tessera.operators.mapping import Join, Rule, Shape, TripleMap, shape
from tessera.plans.algebra import XSD_NUMERIC, Path, Pattern, Term, Var, compatible_join, flat, same_term
from tessera.terms import NULL_MARK, TYPE, encode

INTEGERS = ("tinyint", "smallint", "int", "bigint")

#: Types whose equal values, and only those, have equal texts.
EXACT = (*INTEGERS, "string", "boolean", "date")


# ------------------------------------------------------------------ what a variable stands for


@dataclass(frozen=True)
class Iri:
    """A template over columns of a relation."""

    shape: Shape
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Value:
    """A column as the text of a literal (or of an IRI)."""

    column: str
    kind: str
    dt: str = ""
    lang: str = ""


@dataclass(frozen=True)
class Ready:
    """A column of whole terms."""

    column: str


@dataclass(frozen=True)
class Fixed:
    term: Term


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    vars: dict


def _struct(value: Column, kind: str, dt: str = "", lang: str = "") -> Column:
    return F.struct(value.alias("value"), F.lit(kind).alias("kind"), F.lit(dt).alias("dt"), F.lit(lang).alias("lang"))


def _filled(s: Shape, cols: list[Column], types: list[str]) -> Column:
    """The IRI of a template; whole numbers need no encoding."""
    if s.raw:
        return cols[0].cast("string")
    parts = [F.lit(s.texts[0])]
    for c, t, text in zip(cols, types, s.texts[1:], strict=True):
        parts += [c.cast("string") if t in INTEGERS else encode(c.cast("string")), F.lit(text)]
    return F.concat(*parts)


def shown(df: DataFrame, b) -> Column:
    """A variable as a struct column (value, kind, dt, lang)."""
    if isinstance(b, Ready):
        return F.col(b.column)
    if isinstance(b, Fixed):
        return b.term.column()
    types = dict(df.dtypes)
    if isinstance(b, Value):
        return _struct(F.col(b.column).cast("string"), b.kind, b.dt, b.lang)
    return _struct(_filled(b.shape, [F.col(c) for c in b.columns], [types[c] for c in b.columns]), "uri")


def _same_column(df: DataFrame, other: DataFrame, a: str, b: str) -> Column:
    x, y = dict(df.dtypes)[a], dict(other.dtypes)[b]
    if x == y or x in INTEGERS and y in INTEGERS:
        return F.col(a) == F.col(b)
    return F.col(a).cast("string") == F.col(b).cast("string")


def agree(df: DataFrame, a, other: DataFrame, b) -> Column:
    """The condition that two meanings of a variable are one term."""
    if isinstance(a, Iri) and isinstance(b, Iri):
        if a.shape.apart(b.shape):
            return F.lit(False)
        if a.shape.texts == b.shape.texts and a.shape.raw == b.shape.raw and a.shape.injective:
            test = F.lit(True)
            for x, y in zip(a.columns, b.columns, strict=True):
                test = test & _same_column(df, other, x, y)
            return test
    if isinstance(a, Value) and isinstance(b, Value):
        if (a.kind, a.dt, a.lang) != (b.kind, b.dt, b.lang):
            return F.lit(False)
        return _same_column(df, other, a.column, b.column)
    return shown(df, a) == shown(other, b)


def joined(a: Relation, b: Relation) -> Relation:
    """Two relations joined on the variables that they share, by columns where templates agree."""
    shared = [v for v in a.vars if v in b.vars]
    if not shared:
        return Relation(a.df.crossJoin(b.df), a.vars | b.vars)
    test = F.lit(True)
    for v in shared:
        test = test & agree(a.df, a.vars[v], b.df, b.vars[v])
    return Relation(a.df.join(b.df, test), b.vars | a.vars)


# ------------------------------------------------------------------ the graph


@dataclass(frozen=True)
class Emission:
    """One rule of a map: what gives triples of one predicate."""

    map: TripleMap
    rule: Rule | None = None
    join: Join | None = None

    @property
    def predicate(self) -> str:
        return (self.rule or self.join).predicate

    @property
    def opaque(self) -> bool:
        """Lists, escapes and look-ups are left to the mapping itself."""
        return bool(self.map.lookups) or bool(self.rule and (self.rule.split or self.rule.escape))

    def alone(self) -> TripleMap:
        return replace(self.map, classes=(), rules=(self.rule,) if self.rule else (), joins=(self.join,) if self.join else ())


class MappedGraph:
    """The graph that maps make of their sources, as a dataset of the pattern engine."""

    def __init__(self, maps: list[TripleMap], sources: dict[str, DataFrame], parents: dict[str, TripleMap] | None = None):
        self.maps, self.sources = list(maps), sources
        self.by_name = {m.name: m for m in maps} | (parents or {})
        self.emissions = [Emission(m, r) for m in maps for r in (*(Rule(TYPE, iri=c) for c in m.classes), *m.rules)] + [Emission(m, None, j) for m in maps for j in m.joins]
        self._numbers = itertools.count()

    @property
    def sparkSession(self):  # noqa: N802 (the name that DataFrames have)
        return next(iter(self.sources.values())).sparkSession

    def triples(self, predicates: set[str] | None = None) -> DataFrame:
        """The triples, of some predicates only if they are given."""
        from tessera.terms import SCHEMA

        out = self.sparkSession.createDataFrame([], SCHEMA)
        for m in self.maps:
            few = m if predicates is None else replace(m, classes=m.classes if TYPE in predicates else (), rules=tuple(r for r in m.rules if r.predicate in predicates), joins=tuple(j for j in m.joins if j.predicate in predicates))
            if few.classes or few.rules or few.joins:
                out = out.unionByName(mapping.apply(few, self.sources, self.by_name))
        return out.distinct()

    # one pattern against one rule ------------------------------------------

    def _object(self, e: Emission) -> Shape | None:
        if e.join:
            return shape(self.by_name[e.join.parent].subject)
        return shape(e.rule.iri) if e.rule.iri else None

    def _can(self, t: Pattern, e: Emission) -> bool:
        if isinstance(t.p, Term) and t.p.value != e.predicate:
            return False
        if isinstance(t.s, Term) and (t.s.kind == "literal" or shape(e.map.subject).values(t.s.value) is None):
            return False
        if isinstance(t.o, Term):
            s = self._object(e)
            if s:
                return t.o.kind == "uri" and s.values(t.o.value) is not None
            if e.rule.as_iri:
                return t.o.kind == "uri"
            local = t.o.dt.rsplit("#", 1)[-1]
            return t.o.kind == "literal" and (local == "boolean" or local in XSD_NUMERIC or t.o.lang == e.rule.lang)
        return True

    def _determined(self, e: Emission) -> bool:
        """Is the object a function of the subject?"""
        if e.join or e.rule.when or e.rule.sql:
            return False
        own = self._object(e)
        return set(own.columns if own else (e.rule.column,)) <= set(shape(e.map.subject).columns)

    # scans -----------------------------------------------------------------

    def scan(self, m: TripleMap, chosen: list[tuple[Pattern, Emission]]) -> Relation:
        """The rows of one map's source that meet patterns of one subject."""
        mark = f"_m{next(self._numbers)}_"
        rows = self.sources[m.source]
        if m.when:
            rows = rows.where(m.when)
        out: dict[str, Column] = {}
        names: dict[str, object] = {}
        equal: list = []

        def equals(c: str, value: str) -> Column:
            kind = dict(rows.dtypes)[c]
            if kind in INTEGERS:
                return F.col(c) == int(value) if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", value) and abs(int(value)) < 1 << 63 else F.lit(False)
            return F.col(c).cast("string") == value if kind != "string" else F.col(c) == value

        def kept(c: str, column: Column | None = None) -> str:
            kind = dict(rows.dtypes).get(c)
            x = F.col(c) if column is None else column
            out[mark + c] = x if kind in EXACT or column is not None else x.cast("string")
            return mark + c

        def iri(s: Shape, columns: tuple[str, ...], key: str):
            if s.injective:
                return Iri(s, tuple(kept(c) for c in columns)) if columns else Fixed(Term(s.texts[0]))
            types = dict(rows.dtypes)
            return Ready(kept(key, _struct(_filled(s, [F.col(c) for c in columns], [types[c] for c in columns]), "uri")))

        def meet(x, make):
            """A place of a pattern: a variable takes a meaning, and a second one has to agree."""
            if isinstance(x, Var):
                b = make()
                if x.name in names:
                    equal.append((names[x.name], b))
                else:
                    names[x.name] = b

        subject = shape(m.subject)
        for k, (t, e) in enumerate(chosen):
            if e.join:
                parent = self.by_name[e.join.parent]
                s = shape(parent.subject)
                right = self.sources[parent.source]
                if parent.when:
                    right = right.where(parent.when)
                on, own = f"_on{k}_", f"_own{k}_"
                right = right.select(*(F.col(b).alias(f"{on}{i}") for i, (_, b) in enumerate(e.join.on)), *(F.col(c).alias(own + c) for c in s.columns))
                if not mapping.keyed(parent):
                    right = sizes.distinct(right)
                test = F.lit(True)
                for i, (a, _) in enumerate(e.join.on):
                    test = test & (F.col(a) == F.col(f"{on}{i}"))
                rows = rows.join(right, test)
                o, columns = s, tuple(own + c for c in s.columns)
            else:
                if e.rule.when:
                    rows = rows.where(e.rule.when)
                o = self._object(e)
                columns = o.columns if o else ()
            if o:
                for c in columns:
                    rows = rows.where(F.col(c).isNotNull())
                if o.raw:
                    rows = rows.where(F.col(columns[0]) != "")
                if isinstance(t.o, Term):
                    for c, v in zip(columns, o.values(t.o.value) if columns else (), strict=True):
                        rows = rows.where(equals(c, v))
                meet(t.o, lambda o=o, columns=columns, k=k: iri(o, columns, f"_o{k}"))
            else:
                c = e.rule.column
                if e.rule.sql:
                    c = f"_sql{k}"
                    rows = rows.withColumn(c, F.expr(e.rule.sql).cast("string"))
                rows = rows.where(F.col(c).isNotNull())
                if dict(rows.dtypes)[c] not in INTEGERS:
                    rows = rows.where(~F.col(c).cast("string").isin("", NULL_MARK) if dict(rows.dtypes)[c] != "string" else ~F.col(c).isin("", NULL_MARK))
                kind = "uri" if e.rule.as_iri else "literal"
                if isinstance(t.o, Term):
                    local = t.o.dt.rsplit("#", 1)[-1]
                    plain = local != "boolean" and local not in XSD_NUMERIC
                    rows = rows.where(equals(c, t.o.value) if plain else same_term(_struct(F.col(c).cast("string"), kind, e.rule.datatype, e.rule.lang), t.o))
                meet(t.o, lambda c=c, e=e, kind=kind: Value(kept(c), kind, e.rule.datatype, e.rule.lang))
            meet(t.p, lambda e=e: Fixed(Term(e.predicate)))
        for c in subject.columns:
            rows = rows.where(F.col(c).isNotNull())
        if subject.raw:
            rows = rows.where(F.col(subject.columns[0]) != "")
        t = chosen[0][0]
        if isinstance(t.s, Term):
            for c, v in zip(subject.columns, subject.values(t.s.value), strict=True):
                rows = rows.where(equals(c, v))
        meet(t.s, lambda: iri(subject, subject.columns, "_s"))
        if not mapping.keyed(m):
            # distinct by subject and objects, also where a constant stands for a column
            for c in subject.columns:
                kept(c)
        df = rows.select(*(c.alias(n) for n, c in out.items())) if out else rows.select(F.lit(1).alias(mark + "one"))
        for a, b in equal:
            df = df.where(agree(df, a, df, b))
        if mapping.keyed(m):
            return Relation(df, names)
        return Relation(sizes.distinct(df, *(mark + c for c in subject.columns if mark + c in out)), names)

    def _opaque(self, engine, e: Emission, t: Pattern) -> Relation:
        rows = engine.pattern(mapping.apply(e.alone(), self.sources, self.by_name), t)
        mark = f"_m{next(self._numbers)}_"
        return Relation(rows.select(*(F.col(c).alias(mark + c) for c in rows.columns)), {c: Ready(mark + c) for c in rows.columns if c != "_one"})

    def _together(self, parts: list[Relation], names: list[str], distinct: bool) -> Relation:
        """Alternatives as one relation of whole terms; a single one as it is."""
        if len(parts) == 1:
            return parts[0]
        mark = f"_m{next(self._numbers)}_"
        out = None
        for r in parts:
            rows = r.df.select(*(shown(r.df, r.vars[v]).alias(mark + v) for v in names)) if names else r.df.select(F.lit(1).alias(mark + "one"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            kind = "struct<value:string,kind:string,dt:string,lang:string>"
            out = self.sparkSession.createDataFrame([], ", ".join(f"`{mark}{v}` {kind}" for v in names) or f"{mark}one int")
        return Relation(out.distinct() if distinct else out, {v: Ready(mark + v) for v in names})

    def star(self, engine, patterns: list[Pattern]) -> list[Relation]:
        """Relations whose join meets patterns of one subject."""
        found = [[e for e in self.emissions if self._can(t, e)] for t in patterns]
        maps = {e.map.name: e.map for es in found for e in es}
        mixed = any(not shape(a.subject).apart(shape(b.subject)) for a, b in itertools.combinations(maps.values(), 2))
        if any(e.opaque for es in found for e in es) or mixed and len(patterns) > 1:
            return [self._alone(engine, t, es) for t, es in zip(patterns, found, strict=True)]
        if len(patterns) == 1:
            return [self._alone(engine, patterns[0], found[0])]
        serve = [m for m in maps.values() if all(any(e.map is m for e in es) for es in found)]
        names = list(dict.fromkeys(x.name for t in patterns for x in (t.s, t.p, t.o) if isinstance(x, Var)))
        if len(serve) == 1:
            m = serve[0]
            own = [[e for e in es if e.map is m] for es in found]
            if all(len(es) == 1 for es in own):
                pairs = [(t, es[0]) for t, es in zip(patterns, own, strict=True)]
                free = [p for p in pairs if not self._determined(p[1])]
                if mapping.keyed(m) or len(free) <= 1:
                    return [self.scan(m, pairs)]
                sure = [p for p in pairs if self._determined(p[1])]
                return [self.scan(m, [free[0], *sure]), *(self.scan(m, [p]) for p in free[1:])]
            return [self._alone(engine, t, es) for t, es in zip(patterns, own, strict=True)]
        parts = []
        for m in serve:  # their subjects differ, so no row comes twice
            rows = None
            for t, es in zip(patterns, found, strict=True):
                r = self._alone(engine, t, [e for e in es if e.map is m])
                rows = r if rows is None else joined(rows, r)
            parts.append(rows)
        return [self._together(parts, names, False)]

    def _alone(self, engine, t: Pattern, es: list[Emission]) -> Relation:
        """One pattern: the union of what its rules give, distinct where two may give one triple."""
        names = list(dict.fromkeys(x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)))
        parts = [self._opaque(engine, e, t) if e.opaque else self.scan(e.map, [(t, e)]) for e in es]
        twice = any(a.predicate == b.predicate and not shape(a.map.subject).apart(shape(b.map.subject)) for a, b in itertools.combinations(es, 2))
        return self._together(parts, names, twice)


# ------------------------------------------------------------------ basic graph patterns


def whole(r: Relation) -> DataFrame:
    """A relation's variables as columns of whole terms; without variables, one row if there is any."""
    return r.df.select(*(shown(r.df, b).alias(v) for v, b in r.vars.items())) if r.vars else r.df.limit(1).select(F.lit(1).alias("_one"))


def bgp(engine, graph: MappedGraph, patterns: list[Pattern]) -> DataFrame:
    """The solutions of patterns over a mapped graph, a struct column for each variable."""
    plain, between = flat(patterns)
    stars: dict = {}
    for t in plain:
        if not isinstance(t.p, Path):
            stars.setdefault(t.s, []).append(t)
    # what has most constants first; paths when nothing else is linked to what is joined, as they then start from it
    left = sorted((r for ts in stars.values() for r in graph.star(engine, ts)), key=lambda r: len(r.vars))
    paths = [t for t in plain if isinstance(t.p, Path)]
    done = None
    while left or paths:
        bound = set(done.vars) if done else set()
        ends = lambda t: {x.name for x in (t.s, t.o) if isinstance(x, Var)}
        pick = next((r for r in left if bound & set(r.vars)), None)
        path = None if pick else next((t for t in paths if ends(t) & bound), None) or (next((t for t in paths if len(ends(t)) < 2), None) if done is None else None)
        if path is None and pick is None:
            pick, path = (left[0], None) if left else (None, paths[0])
        if pick is not None:
            left.remove(pick)
            done = pick if done is None else joined(done, pick)
        else:
            paths.remove(path)
            known = whole(done) if done else None
            found = engine.path_pattern(graph, path, known)
            rows = found if known is None else compatible_join(known, found)
            done = Relation(rows, {c: Ready(c) for c in rows.columns if c != "_one"})
    return whole(done).drop(*between)
