"""Graph-pattern algebra, compiled to DataFrames.

A solution has one struct column (value, kind, dt, lang) for each variable; null is unbound. Nodes are
evaluated bottom-up; Catalyst sees one declarative plan and picks the joins.
"""

from __future__ import annotations

import functools
import itertools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reason import closure, cut, edges_of, reach


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    value: str
    kind: str = "uri"
    dt: str = ""
    lang: str = ""

    def column(self) -> Column:
        return F.struct(F.lit(self.value).alias("value"), F.lit(self.kind).alias("kind"), F.lit(self.dt).alias("dt"), F.lit(self.lang).alias("lang"))


@dataclass(frozen=True)
class Path:
    """kind: iri, star (p*), plus (p+), opt (p?), seq (a/b), alt (a|b), inv (^p)."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Pattern:
    s: object
    p: object
    o: object


XSD_NUMERIC = ("integer", "decimal", "double", "gYear", "int", "long", "float", "nonNegativeInteger")


def _object(prefix: str = "") -> Column:
    return F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))


def _node(c: str) -> Column:
    return F.struct(F.col(c).alias("value"), F.when(F.col(c).startswith("_:"), "bnode").otherwise("uri").alias("kind"), F.lit("").alias("dt"), F.lit("").alias("lang"))


def compatible_join(a: DataFrame, b: DataFrame, how: str = "inner", maybe: frozenset = frozenset(), maybe_b: frozenset | None = None) -> DataFrame:
    """Join on shared variables; those in maybe may be unbound and then agree with anything: in a, and in
    b, unless maybe_b says which may be unbound there."""
    maybe_a, maybe_b = maybe, maybe if maybe_b is None else maybe_b
    shared = [c for c in a.columns if c in b.columns]
    loose = [c for c in shared if c in maybe_a | maybe_b]
    tight = [c for c in shared if c not in maybe_a | maybe_b]
    if not loose:
        if tight:
            return a.join(b, tight, how)
        return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    return _loose_join(a, b, how, tight, [c for c in loose if c in maybe_a], [c for c in loose if c in maybe_b])


def _by_binding(df: DataFrame, loose: list[str]):
    """(unbound variables, rows) for each set of variables that may be unbound."""
    for bits in itertools.product((False, True), repeat=len(loose)):
        test = F.lit(True)
        for c, unbound in zip(loose, bits, strict=True):
            test = test & (F.col(c).isNull() if unbound else F.col(c).isNotNull())
        yield {c for c, unbound in zip(loose, bits, strict=True) if unbound}, df.where(test)


def _loose_join(a: DataFrame, b: DataFrame, how: str, tight: list[str], loose_a: list[str], loose_b: list[str]) -> DataFrame:
    """A join where an unbound variable agrees with anything: rows are split by which variables they
    bind, and each pair of parts is joined by equality on what both bind."""
    every = [*tight, *dict.fromkeys([*loose_a, *loose_b])]
    parts = []
    for free_a, rows in _by_binding(a, loose_a):
        rest = rows
        for free_b, other in _by_binding(b, loose_b):
            keys = [c for c in every if c not in free_a | free_b]
            if how == "inner" or how == "left":
                left = rows.drop(*(free_a - free_b))
                right = other.drop(*(c for c in every if c in free_b))
                parts.append(left.join(right, keys) if keys else left.crossJoin(right))
            reduced = other.select(*keys) if keys else other.select(F.lit(1).alias("_any")).limit(1)
            on = keys or F.lit(True)
            if how == "left_semi":
                parts.append(rest.join(reduced, on, "left_semi"))
            if how != "inner":
                rest = rest.join(reduced, on, "left_anti")
        if how in ("left", "left_anti"):
            parts.append(rest)
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def flat(patterns: list[Pattern]) -> tuple[list[Pattern], set[str]]:
    """Sequences and turned steps as patterns of their own; the names of the variables between."""
    out, between = [], set()

    def add(s, p, o):
        if isinstance(p, Path) and p.kind == "seq":
            mid = Var(f"_mid{len(between)}")
            between.add(mid.name)
            add(s, p.args[0], mid)
            add(mid, p.args[1], o)
        elif isinstance(p, Path) and p.kind == "inv":
            add(o, p.args[0], s)
        else:
            out.append(Pattern(s, p, o))

    for t in patterns:
        add(t.s, t.p, t.o)
    return out, between


def inverse(p):
    """The path walked from its other end."""
    if isinstance(p, Term):
        return Path("inv", (p,))
    if p.kind == "inv":
        return p.args[0]
    return Path(p.kind, tuple(map(inverse, reversed(p.args) if p.kind == "seq" else p.args)))


def triples_of(data, predicates: set[str] | None = None) -> DataFrame:
    """A dataset's triples, of a mapped graph those of some predicates only."""
    return data if isinstance(data, DataFrame) else data.triples(predicates)


def ends_of(rows: DataFrame, t: Pattern) -> DataFrame:
    """Rows (_s, _o and perhaps _p) that meet a pattern's constants, as its variables."""
    out: dict[str, str] = {}
    for place, x in (("_s", t.s), ("_p", t.p), ("_o", t.o)):
        if isinstance(x, Var):
            if x.name in out:
                rows = rows.where(F.col(place) == F.col(out[x.name]))
            else:
                out[x.name] = place
        elif isinstance(x, Term) and place in rows.columns and not (place == "_p"):
            rows = rows.where(same_term(F.col(place), x))
    return rows.select(*(F.col(c).alias(n) for n, c in out.items())) if out else rows.select(F.lit(1).alias("_one")).limit(1)


class Engine:
    """Evaluates algebra over named datasets: triples, mapped graphs, or endpoints; '' is the default one."""

    def __init__(self, datasets: dict):
        self.datasets = datasets

    # paths -----------------------------------------------------------------

    def path(self, data, p) -> DataFrame:
        """(a, b) pairs of a path, as struct-free strings; a set."""
        if isinstance(p, Term):
            return edges_of(triples_of(data, {p.value}), p.value)
        if p.kind == "inv":
            return self.path(data, p.args[0]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p.kind == "seq":
            left, right = (self.path(data, x) for x in p.args)
            return left.withColumnRenamed("b", "m").join(right.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        if p.kind == "alt":
            return self.path(data, p.args[0]).union(self.path(data, p.args[1])).distinct()
        inner = self.path(data, p.args[0])
        if p.kind == "plus":
            return closure(inner).select("a", "b")
        every = triples_of(data)
        nodes = every.select(F.col("s").alias("id")).union(every.where("o_kind <> 'literal'").select(F.col("o").alias("id"))).distinct()
        if p.kind == "opt":
            return inner.union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
        return closure(inner, nodes).select("a", "b")

    def from_seeds(self, data, p, seeds: DataFrame) -> DataFrame:
        """(a, b) pairs of a path whose start a is among the seeds (id): what they don't reach is not read.

        A seed reaches itself in no step, whether any triple has it or not.
        """
        if isinstance(p, Term):
            return self.path(data, p).join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
        if p.kind == "seq":
            first = cut(self.from_seeds(data, p.args[0], seeds))
            rest = self.from_seeds(data, p.args[1], first.select(F.col("b").alias("id")).distinct())
            return first.withColumnRenamed("b", "m").join(rest.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        if p.kind == "alt":
            return self.from_seeds(data, p.args[0], seeds).union(self.from_seeds(data, p.args[1], seeds)).distinct()
        if p.kind == "inv":
            return self.path(data, p).join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
        own = seeds.select(F.col("id").alias("a"), F.col("id").alias("b"))
        if p.kind == "opt":
            return self.from_seeds(data, p.args[0], seeds).union(own).distinct()
        found = reach(self.path(data, p.args[0]), seeds).select("a", "b")
        if p.kind == "star":
            return found
        # p+: one step, then any number
        return self.from_seeds(data, Path("seq", (p.args[0], Path("star", p.args))), seeds)

    def path_pattern(self, data, t: Pattern, known: DataFrame | None = None) -> DataFrame:
        """A pattern with a path, from an end that is bound: by a constant, else by the solutions so far.

        With both ends bound the side of fewer values goes first.
        """
        ends = [("s", t.s, t.p), ("o", t.o, inverse(t.p))]
        seeds = {}
        for place, x, _ in ends:
            if isinstance(x, Term) and x.kind != "literal":
                seeds[place] = (1, data.sparkSession.createDataFrame([(x.value,)], "id string"))
            elif isinstance(x, Var) and known is not None and x.name in known.columns:
                own = cut(known.where(F.col(x.name)["kind"] != "literal").select(F.col(x.name)["value"].alias("id")).distinct())
                seeds[place] = (own.count(), own)
        if seeds and not any(isinstance(x, Term) and x.kind == "literal" for _, x, _ in ends):
            place = min(seeds, key=lambda k: seeds[k][0])
            path = next(p for k, _, p in ends if k == place)
            pairs = self.from_seeds(data, path, seeds[place][1])
            pairs = pairs if place == "s" else pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            pairs = self.path(data, t.p)
        return ends_of(pairs.select(_node("a").alias("_s"), _node("b").alias("_o")), t)

    # patterns --------------------------------------------------------------

    def pattern(self, data: DataFrame, t: Pattern) -> DataFrame:
        if isinstance(t.p, Path):
            return self.path_pattern(data, t)
        rows = data
        if isinstance(t.p, Term):
            rows = rows.where(F.col("p") == t.p.value)
        return ends_of(rows.select(_node("s").alias("_s"), _node("p").alias("_p"), _object().alias("_o")), t)

    def bgp(self, data, patterns: list[Pattern]) -> DataFrame:
        """Joins, most bound pattern first, then whatever shares a variable with what is joined."""
        if not isinstance(data, DataFrame):
            from tessera.plans import unfold

            return unfold.bgp(self, data, patterns)
        plain, between = flat(patterns)
        left = sorted(plain, key=lambda t: sum(isinstance(x, Var) for x in (t.s, t.p, t.o)))
        done, names = None, set()
        while left:
            linked = [t for t in left if done is None or names & {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}]
            pick = next((t for t in linked if not isinstance(t.p, Path)), (linked or left)[0])  # paths start from what is bound
            left.remove(pick)
            rows = self.path_pattern(data, pick, done) if isinstance(pick.p, Path) else self.pattern(data, pick)
            names |= {x.name for x in (pick.s, pick.p, pick.o) if isinstance(x, Var)}
            done = rows if done is None else compatible_join(done, rows)
        return done.drop(*between)

    def run(self, node: tuple, data) -> tuple[DataFrame, frozenset]:
        """(solutions, variables that may be unbound)."""
        kind = node[0]
        if kind == "bgp":
            return self.bgp(data, list(node[1])), frozenset()
        if kind in ("join", "left") and node[2][0] == "service" and hasattr(self.datasets.get(node[2][1]), "answers"):
            a, ma = self.run(node[1], data)
            a = cut(a)  # its keys are asked for, then it is joined
            b, mb = self.asked(node[2], a, ma)
            free = (ma | mb) - ((set(a.columns) - ma) | (set(b.columns) - mb)) if kind == "join" else ma | mb | (set(b.columns) - set(a.columns))
            return compatible_join(a, b, "inner" if kind == "join" else "left", ma, mb), free
        if kind == "join":
            (a, ma), (b, mb) = self.run(node[1], data), self.run(node[2], data)
            return compatible_join(a, b, "inner", ma, mb), (ma | mb) - ((set(a.columns) - ma) | (set(b.columns) - mb))
        if kind == "left":  # the filter of an OPTIONAL belongs to its right side and may see the left
            (a, ma), (b, mb) = self.run(node[1], data), self.run(node[2], data)
            if node[3] is None:
                return compatible_join(a, b, "left", ma, mb), ma | mb | (set(b.columns) - set(a.columns))
            key = cut(a.withColumn("_row", F.monotonically_increasing_id()))  # numbered once, for both branches
            hit = compatible_join(key, b, "inner", ma, mb).where(self.truth(node[3]))
            missing = key.join(hit.select("_row").distinct(), "_row", "left_anti")
            return hit.unionByName(missing, allowMissingColumns=True).drop("_row"), ma | mb | (set(b.columns) - set(a.columns))
        if kind == "union":
            (a, ma), (b, mb) = self.run(node[1], data), self.run(node[2], data)
            return a.unionByName(b, allowMissingColumns=True), ma | mb | (set(a.columns) ^ set(b.columns))
        if kind == "filter":
            a, ma = self.run(node[1], data)
            test = node[2]
            if test[0] in ("exists", "not exists"):
                b, mb = self.run(test[1], data)
                return compatible_join(a, b, "left_semi" if test[0] == "exists" else "left_anti", ma, mb), ma
            if mentions_exists(test):
                keyed = cut(a.withColumn("_row", F.monotonically_increasing_id()))  # numbered once, for all branches
                flags: list[str] = []

                def lift(x):
                    nonlocal flagged
                    if x[0] in ("exists", "not exists"):
                        b, mb = self.run(x[1], data)
                        name = f"_seen{len(flags)}"
                        flags.append(name)
                        seen = compatible_join(keyed, b, "left_semi", ma, mb).select("_row", F.lit(True).alias(name))
                        flagged = flagged.join(seen, "_row", "left")
                        return ("flag", name) if x[0] == "exists" else ("not", ("flag", name))
                    return (x[0], *(lift(y) if isinstance(y, tuple) else y for y in x[1:])) if x[0] in ("and", "or", "not") else x

                flagged = keyed
                lifted = lift(test)
                return flagged.where(self.truth(lifted)).drop("_row", *flags), ma
            return a.where(self.truth(test)), ma
        if kind == "values":
            rows = [tuple((t.value, t.kind, t.dt, t.lang) for t in row) for row in node[2]]
            spec = ", ".join(f"`{v}` struct<value:string,kind:string,dt:string,lang:string>" for v in node[1])
            return data.sparkSession.createDataFrame(rows, spec), frozenset()
        if kind == "service" and hasattr(self.datasets.get(node[1]), "answers"):
            return self.asked(node, data.sparkSession.range(1).select(F.lit(1).alias("_one")), frozenset())
        if kind == "service":
            return self.run(node[2], self.datasets[node[1]])
        if kind == "empty":
            return data.sparkSession.range(1).select(F.lit(1).alias("_one")), frozenset()
        raise ValueError(kind)

    def asked(self, node: tuple, known: DataFrame, maybe: frozenset) -> tuple[DataFrame, frozenset]:
        """What an endpoint answers for the solutions so far (bind join); a failed batch is an error.

        Bindings of blank nodes are not sent, as they mean nothing elsewhere.
        """
        from tessera.plans.text import group, variables

        names = variables(node[2])
        bound = [c for c in known.columns if c in names and c not in maybe]
        keys = known.select(*bound).distinct() if bound else known.sparkSession.range(1)
        for c in bound:
            keys = keys.where(F.col(c)["kind"] != "bnode")
        got = cut(self.datasets[node[1]].answers(keys, group(node[2]), names))
        failed = got.where("error IS NOT NULL").select("error").limit(1).collect()
        if failed:
            raise ValueError(f"SERVICE <{node[1]}>: {failed[0].error}")
        return got.drop("error"), frozenset(names) - frozenset(bound)

    # expressions -----------------------------------------------------------

    def truth(self, e: tuple) -> Column:
        """A filter's value: errors and unbound operands are null, which drops the row."""
        k = e[0]
        if k == "and":
            return functools.reduce(operator.and_, map(self.truth, e[1:]))
        if k == "or":
            return functools.reduce(operator.or_, map(self.truth, e[1:]))
        if k == "flag":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if k == "not":
            return ~self.truth(e[1])
        if k in ("=", "!="):
            same = self.equal(e[1], e[2])
            return same if k == "=" else ~same
        if k in ("<", ">", "<=", ">="):
            # numbers by value, other texts by their code points
            numbers, texts = (self.number(e[1]), self.number(e[2])), (self.text(e[1]), self.text(e[2]))
            one = lambda a, b: {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[k]
            return F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), one(*numbers)).when(numbers[0].isNull() & numbers[1].isNull(), one(*texts))
        if k == "in":
            test = F.lit(False)
            for x in e[2]:
                test = test | self.equal(e[1], x)
            return test
        if k == "call":
            name, args = e[1], e[2]
            if name in ("ISIRI", "ISURI"):
                return self.term(args[0])["kind"] == "uri"
            if name == "ISBLANK":
                return self.term(args[0])["kind"] == "bnode"
            if name == "ISLITERAL":
                return self.term(args[0])["kind"] == "literal"
            if name == "BOUND":
                return self.term(args[0]).isNotNull()
            if name == "CONTAINS":
                return F.contains(self.text(args[0]), self.text(args[1]))
            if name == "STRSTARTS":
                return F.startswith(self.text(args[0]), self.text(args[1]))
            if name == "STRENDS":
                return F.endswith(self.text(args[0]), self.text(args[1]))
            if name == "REGEX":
                flags = args[2][1].value if len(args) > 2 else ""
                return F.rlike(self.text(args[0]), F.concat(F.lit(f"(?{flags})" if flags else ""), self.text(args[1])))
        return self.text(e) == "true"

    def term(self, e: tuple) -> Column:
        if e[0] == "var":
            return F.col(e[1])
        if e[0] == "term":
            return e[1].column()
        if e[0] == "call" and e[1] == "COALESCE":
            return F.coalesce(*(self.term(x) for x in e[2]))
        return F.struct(self.text(e).alias("value"), F.lit("literal").alias("kind"), F.lit("").alias("dt"), F.lit("").alias("lang"))

    def text(self, e: tuple) -> Column:
        if e[0] == "call":
            name, args = e[1], e[2]
            if name == "STR":
                return self.text(args[0])
            if name == "LCASE":
                return F.lower(self.text(args[0]))
            if name == "UCASE":
                return F.upper(self.text(args[0]))
            if name == "LANG":
                return self.term(args[0])["lang"]
            if name == "DATATYPE":
                return self.term(args[0])["dt"]
            if name in TESTS:
                return self.truth(e).cast("string")
            if name != "COALESCE":
                raise ValueError(f"unsupported function {name}")
        elif e[0] not in ("var", "term"):
            return self.truth(e).cast("string")
        return self.term(e)["value"]

    def number(self, e: tuple) -> Column:
        return self.text(e).try_cast("double")

    def equal(self, a: tuple, b: tuple) -> Column:
        """Numbers by value, plain texts (calls) by text, else term by term."""
        if "call" in (a[0], b[0]) and "COALESCE" not in (a[1], b[1]):
            return self.text(a) == self.text(b)
        for x, y in ((a, b), (b, a)):
            if x[0] == "term":
                return same_term(self.term(y), x[1])
        x, y = self.term(a), self.term(b)
        numeric = lambda t: F.substring_index(t["dt"], "#", -1).isin(*XSD_NUMERIC)
        same = (x["value"] == y["value"]) & (x["kind"] == y["kind"]) & (x["lang"] == y["lang"])
        return F.when(numeric(x) & numeric(y), x["value"].try_cast("double") == y["value"].try_cast("double")).otherwise(same)


#: Functions whose value is true or false.
TESTS = {"ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "BOUND", "CONTAINS", "STRSTARTS", "STRENDS", "REGEX"}


def mentions_exists(e) -> bool:
    """Is there an EXISTS in a filter's boolean expression?"""
    return isinstance(e, tuple) and bool(e) and (e[0] in ("exists", "not exists") or e[0] in ("and", "or", "not") and any(map(mentions_exists, e[1:])))


def same_term(c: Column, t: Term) -> Column:
    """Is a struct column the given term? Booleans and numbers agree by value."""
    local = t.dt.rsplit("#", 1)[-1]
    if local == "boolean":
        return (c["kind"] == "literal") & F.when(F.lit(t.value in ("true", "1")), c["value"].isin("true", "1")).otherwise(c["value"].isin("false", "0"))
    if local in XSD_NUMERIC:
        return (c["kind"] == "literal") & (c["value"].try_cast("double") == float(t.value))
    return (c["value"] == t.value) & (c["kind"] == t.kind) & (c["lang"] == t.lang)


def plain(df: DataFrame) -> DataFrame:
    """Solutions with each variable as the text of its term."""
    return df.select(*(F.col(c)["value"].alias(c) if "struct" in t else F.col(c) for c, t in df.dtypes if c != "_one"))
