"""Declarative mappings from relations to triples.

A map has a source, a subject template, an optional condition on whole rows, and predicate-object
rules. One scan emits all its triples: each row becomes an array of term structs that is exploded,
with the joined rules as joins of their own. Empty and marked-null values give no triple.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import sizes
from tessera.terms import NULL_MARK, TRIPLE, TYPE, encode, template


@dataclass(frozen=True)
class Shape:
    """A template's fixed texts and the columns between them; raw: one column that holds whole IRIs."""

    texts: tuple[str, ...]
    columns: tuple[str, ...]
    raw: bool = False

    @property
    def injective(self) -> bool:
        """Do different values always give different IRIs? Encoded values hold none of / : ? # etc."""
        return all(re.search(r"[^A-Za-z0-9\-._~%]", t) for t in self.texts[1:-1])

    def values(self, iri: str) -> tuple[str, ...] | None:
        """The column values that give an IRI, if any do."""
        if self.raw:
            return (iri,)
        m = re.fullmatch("([A-Za-z0-9\\-._~%]*)".join(map(re.escape, self.texts)), iri)
        if not m:
            return None
        got = tuple(map(unquote, m.groups()))
        return got if tuple(quote(v, safe="") for v in got) == m.groups() else None

    def apart(self, other: Shape) -> bool:
        """Can no IRI come from both? Told from the fixed texts at either end, where columns follow."""
        if self.raw or other.raw:
            return False
        if not self.columns and not other.columns:
            return self.texts != other.texts
        for fixed, open_ in ((self, other), (other, self)):
            if not fixed.columns:
                return open_.values(fixed.texts[0]) is None
        a, b = self.texts[0], other.texts[0]
        if not (a.startswith(b) or b.startswith(a)):
            return True
        a, b = self.texts[-1][::-1], other.texts[-1][::-1]
        return not (a.startswith(b) or b.startswith(a))


def shape(text: str) -> Shape:
    if text.startswith("{") and text.endswith("}") and text.count("{") == 1:
        return Shape(("", ""), (text[1:-1],), True)
    pieces = re.split(r"\{([^{}]*)\}", text)
    return Shape(tuple(pieces[::2]), tuple(pieces[1::2]))


@dataclass(frozen=True)
class Rule:
    """predicate with one of: constant, template, reference (a column), or list (split) values."""

    predicate: str
    iri: str | None = None  # a template or constant IRI
    column: str | None = None  # a literal from a column
    datatype: str = ""
    lang: str = ""
    when: str | None = None  # SQL condition on the row
    split: str | None = None  # a separator: one triple for each piece
    as_iri: bool = False  # the column already holds an IRI
    sql: str | None = None  # a literal from an SQL expression
    escape: bool = False  # each value percent-encoded


@dataclass(frozen=True)
class Join:
    """predicate to the subject of another map, where this source's columns equal the parent's."""

    predicate: str
    parent: str
    on: tuple[tuple[str, str], ...]  # (child column, parent column), compared column by column


@dataclass(frozen=True)
class Lookup:
    """A column found in another source: the value beside the key, the least if there are several."""

    source: str
    key: str  # SQL over the row
    from_column: int
    to_column: int
    out: str


@dataclass(frozen=True)
class TripleMap:
    name: str
    source: str
    subject: str  # a template, or {column} alone for a column of IRIs
    classes: tuple[str, ...] = ()
    when: str | None = None
    rules: tuple[Rule, ...] = ()
    joins: tuple[Join, ...] = field(default=())
    lookups: tuple[Lookup, ...] = field(default=())
    key: tuple[str, ...] = ()  # columns of which no two rows of the source have the same values


def _subject(text: str) -> Column:
    if text.startswith("{") and text.endswith("}") and text.count("{") == 1:
        return F.col(text[1:-1])
    return template(text)


def _term(rule: Rule) -> Column:
    """An array of (o, o_kind): empty where the rule emits nothing."""
    if rule.iri:
        value, kind = F.array(template(rule.iri)), "uri"
    else:
        c = (F.expr(rule.sql) if rule.sql else F.col(rule.column)).cast("string")
        # a null list is one without pieces: it must not take the row's other terms with it
        value = F.coalesce(F.transform(F.split(c, rule.split), lambda x: F.trim(x)), F.array().cast("array<string>")) if rule.split else F.array(c)
        kind = "uri" if rule.as_iri else "literal"
    full = F.filter(value, lambda v: v.isNotNull() & (v != "") & (v != F.lit(NULL_MARK)))
    if rule.escape:
        full = F.transform(full, encode)
    out = F.transform(full, lambda v: F.struct(F.lit(rule.predicate).alias("p"), v.alias("o"), F.lit(kind).alias("o_kind"), F.lit(rule.datatype).alias("o_dt"), F.lit(rule.lang).alias("o_lang")))
    none = F.array().cast("array<struct<p:string,o:string,o_kind:string,o_dt:string,o_lang:string>>")
    return F.when(F.expr(rule.when), out).otherwise(none) if rule.when else out


def keyed(m: TripleMap) -> bool:
    """Does every row of the source have a subject of its own?"""
    s = shape(m.subject)
    return bool(m.key) and set(m.key) <= set(s.columns) and s.injective


def _columns(m: TripleMap) -> list[str] | None:
    """The columns of which a map's rules are functions, if they are the subject's own: rows that are
    alike in them give the same triples, others give other ones."""
    s = shape(m.subject)
    if not s.injective or m.when or m.lookups or any(r.when or r.sql or r.escape for r in m.rules):
        return None
    need = {c for r in m.rules for c in (shape(r.iri).columns if r.iri else (r.column,))}
    return list(s.columns) if need <= set(s.columns) else None


def apply(m: TripleMap, sources: dict[str, DataFrame], maps: dict[str, TripleMap] | None = None) -> DataFrame:
    """The triples of one map, without duplicates.

    Where the subject is a declared key no row gives another's triples; where all depends on the
    subject's columns, rows are made distinct in those; else triples are.
    """
    rows = sources[m.source]
    for x in m.lookups:
        found = sources[x.source]
        a, b = found.columns[x.from_column], found.columns[x.to_column]
        found = found.groupBy(F.col(a).alias(f"{x.out}_key")).agg(F.min(b).alias(x.out))
        rows = rows.join(found, F.expr(x.key) == F.col(f"{x.out}_key"), "left").drop(f"{x.out}_key")
    if m.when:
        rows = rows.where(m.when)
    rules = [*(Rule(TYPE, iri=c) for c in m.classes), *m.rules]
    # rows without a subject: told by its columns, before the template is filled
    subject = shape(m.subject)
    for c in subject.columns:
        rows = rows.where(F.col(c).isNotNull())
    if subject.raw:
        rows = rows.where(F.col(subject.columns[0]) != "")
    parts = []
    single, narrow = keyed(m), _columns(m)
    if rules:
        terms = F.flatten(F.array(*map(_term, rules)))
        if single or narrow:
            # dealt first: a row becomes several triples
            own = sizes.dealt(rows, *m.key) if single else sizes.distinct(rows.select(*narrow))
            parts.append(own.select(_subject(m.subject).alias("s"), F.explode(F.array_distinct(terms)).alias("t")).select("s", "t.*"))
        else:
            parts.append(sizes.distinct(rows.select(_subject(m.subject).alias("s"), F.explode(terms).alias("t")).select("s", "t.*"), "s", "o"))
    for j in m.joins:
        parent = maps[j.parent]
        child = rows.select(_subject(m.subject).alias("s"), *(F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(j.on)))
        right = sources[parent.source]
        if parent.when:
            right = right.where(parent.when)
        right = right.select(_subject(parent.subject).alias("o"), *(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(j.on)))
        joined = child.join(right, [f"_k{i}" for i in range(len(j.on))]).where("o <> ''")
        parts.append(sizes.distinct(joined.select("s", F.lit(j.predicate).alias("p"), "o", F.lit("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")), "s", "o"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(*TRIPLE) if any(subject.texts) else out.where("s <> ''").select(*TRIPLE)
    # a join may give what a rule of its predicate, or another join, gives
    joins = [j.predicate for j in m.joins]
    return sizes.distinct(out, "s", "o") if len(set(joins)) < len(joins) or set(joins) & {r.predicate for r in rules} else out


def apply_all(maps: list[TripleMap], sources: dict[str, DataFrame]) -> DataFrame:
    by_name = {m.name: m for m in maps}
    made = [apply(m, sources, by_name) for m in maps if m.classes or m.rules or m.joins]
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    return sizes.distinct(out, "s", "o")
