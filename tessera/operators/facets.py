"""Faceted search over triples: discovery, result pages, totals, self-excluding counts, cards, state."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators.reason import cut, edges_of, list_members, reach, turned

PAGE, CAP, MOST_PAGES = 50, 1000, 20


@dataclass(frozen=True)
class Facet:
    """kind: enum (values), year or integer (low, high, either open), boolean (value), text (value)."""

    prop: str
    kind: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    value: str = ""


@dataclass(frozen=True)
class State:
    root: str
    page: int = 1
    q: str = ""
    facets: tuple[Facet, ...] = field(default=())

    def with_root(self, root: str) -> State:
        return State(root)

    def with_facet(self, prop: str, facet: Facet | None) -> State:
        """A changed facet starts at page 1; None takes it away."""
        rest = tuple(f for f in self.facets if f.prop != prop)
        return replace(self, page=1, facets=rest + ((facet,) if facet else ()))

    def with_query(self, q: str) -> State:
        return replace(self, page=1, q=q)

    def fingerprint(self) -> tuple:
        """What facet counts depend on: all but the page."""
        return (self.root, self.q.strip(), tuple(sorted(map(repr, self.facets))))

    def to_params(self) -> str:
        out = [("root", self.root)]
        if self.q:
            out.append(("q", self.q))
        if self.page != 1:
            out.append(("page", str(self.page)))
        for f in self.facets:
            key = f"{f.kind}:{f.prop}"
            out += [(key, v) for v in f.values]
            out += [(key + end, str(int(bound)) if float(bound).is_integer() else repr(float(bound))) for end, bound in (("_from", f.low), ("_to", f.high)) if bound is not None]
            if f.value:
                out.append((key, f.value))
        return urlencode(out)

    @classmethod
    def from_params(cls, text: str) -> State:
        root, q, page, found = "", "", 1, {}
        for k, v in parse_qsl(text):
            if k == "root":
                root = v
            elif k == "q":
                q = v
            elif k == "page":
                page = int(v)
            else:
                kind, prop = k.split(":", 1)
                name = "low" if prop.endswith("_from") else "high" if prop.endswith("_to") else None
                if kind in ("year", "integer") and name:
                    prop = prop.removesuffix("_from" if name == "low" else "_to")
                    found[prop] = replace(found.get(prop, Facet(prop, kind)), **{name: float(v)})
                elif kind == "enum":
                    old = found.get(prop, Facet(prop, kind))
                    found[prop] = replace(old, values=(*old.values, v))
                else:
                    found[prop] = Facet(prop, kind, value=v)
        return cls(root, page, q, tuple(found.values()))


def satisfies(f: Facet) -> Column:
    """Does a property's triple satisfy a facet? Any one of a work's values may."""
    o = F.col("o")
    if f.kind == "enum":
        return o.isin(*f.values)
    if f.kind in ("year", "integer"):
        n, test = T.year_number(o), F.lit(True)
        if f.low is not None:
            test = test & (n >= f.low)
        if f.high is not None:
            test = test & (n <= f.high)
        return test
    if f.kind == "boolean":
        return T.boolean(o) == (f.value in ("true", "1"))
    return F.contains(F.lower(o), F.lit(f.value.lower())) if f.value.strip() else F.lit(True)


def instances(triples: DataFrame, root: str, sub_classes: DataFrame | None = None) -> DataFrame:
    """work: subjects typed root; with sub_classes (a closure), also those typed below it."""
    types = triples.where(F.col("p") == T.TYPE)
    if sub_classes is None:
        return types.where(F.col("o") == root).select(F.col("s").alias("work")).distinct()
    below = sub_classes.where(F.col("b") == root).select(F.col("a").alias("o"))
    return types.join(F.broadcast(below), "o").select(F.col("s").alias("work")).distinct()


def _base(triples: DataFrame, state: State, label_props: list[str], works: DataFrame | None) -> DataFrame:
    works = instances(triples, state.root) if works is None else works
    if state.q.strip():
        hit = triples.where(F.col("p").isin(label_props) & F.contains(F.lower("o"), F.lit(state.q.strip().lower()))).select(F.col("s").alias("work"))
        works = works.join(hit, "work", "left_semi")
    return works


def matches(triples: DataFrame, state: State, label_props: list[str], works: DataFrame | None = None) -> DataFrame:
    """work: across facets all, within a facet any."""
    out = _base(triples, state, label_props, works)
    for f in state.facets:
        out = out.join(triples.where((F.col("p") == f.prop) & satisfies(f)).select(F.col("s").alias("work")), "work", "left_semi")
    return out


def labelled(works: DataFrame, triples: DataFrame, label_props: list[str]) -> DataFrame:
    """work, label: the smallest label of the first property that has one, else the local name."""
    rank = F.array_position(F.array(*map(F.lit, label_props)), F.col("p"))
    labels = triples.where(F.col("p").isin(label_props) & F.col("o_lang").isin("", "en")).groupBy(F.col("s").alias("work")).agg(F.min(F.struct(rank.alias("r"), F.col("o").alias("label"))).alias("l"))
    return works.join(labels, "work", "left").select("work", F.coalesce("l.label", T.local_name(F.col("work"))).alias("label"))


def page(triples: DataFrame, state: State, label_props: list[str], works: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """work, label of one page, by label, then IRI."""
    rows = labelled(matches(triples, state, label_props, works), triples, label_props)
    return rows.orderBy("label", "work").offset((min(state.page, MOST_PAGES) - 1) * size).limit(size)


def total(triples: DataFrame, state: State, label_props: list[str], works: DataFrame | None = None) -> DataFrame:
    """total, capped: works that match, and whether the display says 1000+."""
    return matches(triples, state, label_props, works).agg(F.countDistinct("work").alias("total")).withColumn("capped", F.col("total") > CAP)


def counts(triples: DataFrame, state: State, props: list[str], label_props: list[str], works: DataFrame | None = None) -> DataFrame:
    """prop, value, n: counts of each facet under all other facets, not its own, in one pass.

    Each work gets a bit for every active facet it satisfies; a facet's values count works whose bits
    are all set but perhaps its own.
    """
    base = _base(triples, state, label_props, works)
    active = [f for f in state.facets]
    full = (1 << len(active)) - 1
    if active:
        bits = F.lit(0)
        for k, f in enumerate(active):
            bits = bits.bitwiseOR(F.when((F.col("p") == f.prop) & satisfies(f), 1 << k).otherwise(0))
        masks = triples.where(F.col("p").isin([f.prop for f in active])).groupBy(F.col("s").alias("work")).agg(F.bit_or(bits).alias("mask"))
        base = base.join(masks, "work", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    else:
        base = base.withColumn("mask", F.lit(0))
    own = F.lit(0)
    for k, f in enumerate(active):
        own = F.when(F.col("prop") == f.prop, 1 << k).otherwise(own)
    values = triples.where(F.col("p").isin(props)).select(F.col("s").alias("work"), F.col("p").alias("prop"), F.col("o").alias("value")).distinct()
    return values.join(base, "work").where(F.col("mask").bitwiseOR(own) == full).groupBy("prop", "value").agg(F.count("*").alias("n"))


class Results:
    """Facet results of a catalogue's dataset, kept by what they depend on.

    Counts and total of a state are made in one pass, written, and used again for every state of the
    same fingerprint, so for another page of it; a change of the dataset drops them. At most ``most``
    states are kept, the latest used.
    """

    def __init__(self, catalog, dataset: str, props: list[str], label_props: list[str], most: int = 200):
        self.catalog, self.dataset, self.props, self.label_props, self.most = catalog, dataset, props, label_props, most
        self._kept: dict = {}
        self._version = None

    def _found(self, state: State) -> DataFrame:
        """prop, value, n; the total of works is that of the empty prop."""
        if self._version != self.catalog.version(self.dataset):
            self._kept.clear()
            self._version = self.catalog.version(self.dataset)
        key = state.fingerprint()
        found = self._kept.pop(key, None)
        if found is None:
            triples = self.catalog[self.dataset]
            works = cut(instances(triples, state.root))
            # a work's total is a value of a property that every work has and no facet restricts
            every = works.select(F.col("work").alias("s"), F.lit("").alias("p"), F.lit("").alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
            found = cut(counts(triples.unionByName(every), state, [*self.props, ""], self.label_props, works))
        self._kept[key] = found
        while len(self._kept) > self.most:
            self._kept.pop(next(iter(self._kept)))
        return found

    def counts(self, state: State) -> DataFrame:
        return self._found(state).where("prop <> ''")

    def total(self, state: State) -> DataFrame:
        return self._found(state).where("prop = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("capped", F.col("total") > CAP)

    def page(self, state: State) -> DataFrame:
        return page(self.catalog[self.dataset], state, self.label_props)


def counts_with_zero(values: DataFrame, counted: DataFrame) -> DataFrame:
    """All values (prop, value, label) with n, 0 where nothing is left; by count, then label."""
    return values.join(counted, ["prop", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).orderBy("prop", F.desc("n"), "label")


def card(triples: DataFrame, iri: str, label_props: list[str]) -> DataFrame:
    """prop, is_object, vals: what a page shows of an entity; object fields first."""
    skip = [T.TYPE, T.SUB_CLASS, T.SAME_AS, *label_props]
    rows = triples.where((F.col("s") == iri) & ~F.col("p").isin(skip) & ~((F.col("o_kind") == "uri") & F.col("o").isin(T.THING, T.NAMED_INDIVIDUAL)))
    named = triples.where(F.col("p").isin(label_props)).groupBy(F.col("s").alias("o")).agg(F.min("o").alias("_label"))
    shown = rows.join(named, "o", "left").withColumn("shown", F.when(F.col("o_kind") == "uri", F.coalesce("_label", T.local_name(F.col("o")))).otherwise(F.col("o")))
    out = shown.groupBy(F.col("p").alias("prop"), (F.col("o_kind") == "uri").alias("is_object")).agg(F.array_sort(F.collect_set("shown")).alias("vals"))
    return out.orderBy(F.desc("is_object"), "prop")


def bounds(triples: DataFrame, works: DataFrame, prop: str) -> DataFrame:
    """low, high of a year property over works; nulls if there is none."""
    years = triples.where(F.col("p") == prop).select(F.col("s").alias("work"), T.year_number(F.col("o")).alias("y")).join(works, "work", "left_semi")
    return years.agg(F.min("y").alias("low"), F.max("y").alias("high"))


# ------------------------------------------------------------------ discovery


def classes(schema: DataFrame, root: str) -> DataFrame:
    """iri, label: root and the classes below it."""
    below = reach(turned(edges_of(schema, T.SUB_CLASS)), schema.sparkSession.createDataFrame([(root,)], "id string")).select(F.col("b").alias("work"))
    return labelled(below, schema, [T.LABEL]).withColumnRenamed("work", "iri")


def domains(schema: DataFrame) -> DataFrame:
    """(prop, domain): named domains, and members of unions where no named domain is asserted."""
    all_ = edges_of(schema, T.DOMAIN).select(F.col("a").alias("prop"), F.col("b").alias("domain"))
    named = all_.where(~F.col("domain").startswith("_:"))
    unions = edges_of(schema, T.OWL + "unionOf").select(F.col("a").alias("domain"), F.col("b").alias("head"))
    flat = all_.join(unions, "domain").join(list_members(schema), "head").select("prop", F.col("member").alias("domain"))
    return named.unionByName(flat.join(named.select("prop"), "prop", "left_anti")).where(F.col("domain") != T.THING).distinct()


def properties(schema: DataFrame, root: str) -> DataFrame:
    """prop, range, is_object: properties whose domain is the root, above or below it."""
    tree, own = edges_of(schema, T.SUB_CLASS), schema.sparkSession.createDataFrame([(root,)], "id string")
    around = reach(tree, own).union(reach(turned(tree), own)).select(F.col("b").alias("domain")).distinct()
    found = domains(schema).join(around, "domain", "left_semi").select("prop").distinct()
    ranges = schema.where((F.col("p") == T.RANGE) & (F.col("o_kind") == "uri")).groupBy(F.col("s").alias("prop")).agg(F.min("o").alias("range"))
    objects = schema.where((F.col("p") == T.TYPE) & (F.col("o") == T.OWL + "ObjectProperty")).select(F.col("s").alias("prop"), F.lit(True).alias("is_object")).distinct()
    return found.join(ranges, "prop", "left").join(objects, "prop", "left").withColumn("is_object", F.coalesce("is_object", F.lit(False)))


def label_properties(schema: DataFrame, root: str) -> DataFrame:
    """prop, depth: applicable sub-properties of rdfs:label by distance, then rdfs:label itself."""
    label = schema.sparkSession.createDataFrame([(T.LABEL,)], "id string")
    up = reach(turned(edges_of(schema, T.SUB_PROPERTY)), label).where("depth > 0").select(F.col("b").alias("prop"), "depth")
    own = schema.select(F.lit(T.LABEL).alias("prop"), F.lit(1 << 20).alias("depth")).limit(1)
    return up.join(properties(schema, root).select("prop"), "prop", "left_semi").unionByName(own).orderBy("depth", "prop")


def enum_values(schema: DataFrame, range_: str) -> DataFrame:
    """value, label of the individuals of a class, by label."""
    rows = schema.where((F.col("p") == T.TYPE) & (F.col("o") == range_)).select(F.col("s").alias("work")).distinct()
    return labelled(rows, schema, [T.LABEL]).withColumnRenamed("work", "value").orderBy("label", "value")


def kind_of(is_object: bool, range_: str | None, is_vocabulary: bool) -> str | None:
    """The control of a property, or None where it has none."""
    if is_object:
        return "enum" if is_vocabulary else None
    local = (range_ or "").rsplit("#", 1)[-1]
    return {"gYear": "year", "boolean": "boolean", "integer": "integer", "decimal": "integer", "double": "integer", "string": "text"}.get(local)


def vocabularies(schema: DataFrame, ranges: DataFrame) -> DataFrame:
    """range, is_vocabulary: does a class have a named individual?"""
    typed = schema.where(F.col("p") == T.TYPE).select("s", "o")
    members = typed.join(typed.where(F.col("o") == T.NAMED_INDIVIDUAL).select("s"), "s", "left_semi").select(F.col("o").alias("range"), F.lit(True).alias("found")).distinct()
    return ranges.select("range").distinct().join(members, "range", "left").select("range", F.coalesce("found", F.lit(False)).alias("is_vocabulary"))


def search_values(values: DataFrame, text: str, most: int = 10) -> DataFrame:
    """The values whose label contains a text in any case; a list of ``most`` values or fewer stays whole."""
    if not text or values.limit(most + 1).count() <= most:
        return values
    return values.where(F.contains(F.lower("label"), F.lower(F.lit(text))))


def by_name(rows: DataFrame, column: str = "label", *then: str) -> DataFrame:
    """Rows in the order of a dictionary, in which case and accents come after letters."""
    return rows.orderBy(F.collate(F.col(column), "UNICODE"), *then)


def counts_each(triples: DataFrame, state: State, props: list[str], label_props: list[str], works: DataFrame | None = None) -> dict[str, DataFrame]:
    """counts() by property, each computed by itself: one that fails is empty, and the others keep theirs."""
    out = {}
    for prop in props:
        try:
            out[prop] = cut(counts(triples, state, [prop], label_props, works))
        except PySparkException:
            out[prop] = triples.sparkSession.createDataFrame([], "prop string, value string, n long")
    return out
