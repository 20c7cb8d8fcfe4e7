"""Queries over the driver's tables, one for each operator family, and the SQL that checks them.

The relational tables stand for a knowledge graph: customers and suppliers are people, parts are
works, line items are contributions (of a supplier to a part), orders give them dates, brands and
types are vocabularies, and regions, nations and customers form a hierarchy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import sizes
from tessera import terms as T
from tessera.functions import scalar
from tessera.operators import entity, facets, federation, mapping, prepare, reason
from tessera.operators.mapping import Join, Rule, TripleMap
from tessera.plans import sparql
from tessera.plans.algebra import Engine
from tessera.plans.unfold import MappedGraph
from tessera.sources import files
from tessera.sources.files import Catalog, format_ntriples, parse_ntriples

EX = "http://example.org/"
O = EX + "onto#"  # noqa: E741

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, table) -> DataFrame under its name, with its oracle."""

    def add(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, lambda t: sizes.ready(spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ the graph

PART = TripleMap(
    "part", "part", EX + "part/{p_partkey}", (O + "Part",),
    rules=(Rule(T.LABEL, column="p_name"), Rule(O + "brand", iri=EX + "brand/{p_brand}"), Rule(O + "type", iri=EX + "type/{p_type}"), Rule(O + "size", column="p_size", datatype=T.XSD + "integer"), Rule(O + "big", column="p_big", datatype=T.XSD + "boolean")),
    key=("p_partkey",),
)
CREDIT = TripleMap(
    "credit", "lineitem", EX + "credit/{l_orderkey}/{l_linenumber}/{l_partkey}/{l_suppkey}", (O + "Credit",),
    rules=(Rule(O + "by", iri=EX + "supplier/{l_suppkey}"), Rule(O + "involves", iri=EX + "part/{l_partkey}"), Rule(O + "order", column="l_linenumber", datatype=T.XSD + "integer")),
)
PERSON = TripleMap("person", "supplier", EX + "supplier/{s_suppkey}", (O + "Person",), rules=(Rule(O + "name", column="s_name"),), joins=(Join(O + "from", "nation", (("s_nationkey", "n_nationkey"),)),), key=("s_suppkey",))
BUYER = TripleMap("buyer", "customer", EX + "customer/{c_custkey}", (O + "Person",), rules=(Rule(O + "name", column="c_name"),), key=("c_custkey",))
PURCHASE = TripleMap("purchase", "orders", EX + "order/{o_orderkey}", (O + "Order",), rules=(Rule(O + "buyer", iri=EX + "customer/{o_custkey}"), Rule(O + "year", column="o_year", datatype=T.XSD + "gYear")), key=("o_orderkey",))
NATION = TripleMap("nation", "nation", EX + "nation/{n_nationkey}", (O + "Nation",), rules=(Rule(T.LABEL, column="n_name"),), joins=(Join(O + "partOf", "region", (("n_regionkey", "r_regionkey"),)),), key=("n_nationkey",))
REGION = TripleMap("region", "region", EX + "region/{r_regionkey}", (O + "Region",), rules=(Rule(T.LABEL, column="r_name"),), key=("r_regionkey",))
MAPS = {m.name: m for m in (PART, CREDIT, PERSON, BUYER, PURCHASE, NATION, REGION)}


def _sources(table, names) -> dict[str, DataFrame]:
    out = {n: table(n) for n in names}
    if "orders" in out:
        out["orders"] = out["orders"].withColumn("o_year", F.year("o_orderdate").cast("string"))
    if "part" in out:
        out["part"] = out["part"].withColumn("p_big", F.when(F.col("p_size") > 25, "1").otherwise("false"))
    return out


def graph(table, *maps: str) -> DataFrame:
    """The triples of some maps."""
    need = {MAPS[m].source for m in maps} | {MAPS[j.parent].source for m in maps for j in MAPS[m].joins}
    made = [mapping.apply(MAPS[m], _sources(table, need), MAPS) for m in maps]
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    return out


def virtual(table, *maps: str) -> MappedGraph:
    """The graph of some maps, of which patterns read what they need."""
    need = {MAPS[m].source for m in maps} | {MAPS[j.parent].source for m in maps for j in MAPS[m].joins}
    return MappedGraph([MAPS[m] for m in maps], _sources(table, need), MAPS)


def ask(data: DataFrame | MappedGraph | dict, text: str) -> DataFrame:
    sets = data if isinstance(data, dict) else {"": data}
    return sparql.query(Engine(sets), text, prefixes={"o": O, "rdfs": T.RDFS, "rdf": T.RDF, "owl": T.OWL, "xsd": T.XSD})


def ontology(spark) -> DataFrame:
    """A small schema for the graph."""
    rows = []
    add = lambda s, p, o: rows.append((s, p, o, "bnode" if o.startswith("_:") else "uri", "", ""))
    for c, sup in (("Supplier", "Person"), ("Person", "Agent"), ("Organisation", "Agent"), ("Part", "Work"), ("BigPart", "Part"), ("Credit", "Event"), ("Order", "Event")):
        add(O + c, T.SUB_CLASS, O + sup)
    for p, d, r in (("by", "Credit", "Supplier"), ("involves", "Credit", "Part"), ("name", None, "string"), ("brand", "Part", "Brand"), ("type", "Part", "Type"), ("size", "Part", "integer"), ("from", "Person", "Nation"), ("title", "Work", "string")):
        xsd = r in ("string", "integer")
        add(O + p, T.RANGE, (T.XSD if xsd else O) + r)
        add(O + p, T.TYPE, T.OWL + ("DatatypeProperty" if xsd else "ObjectProperty"))
        if d:
            add(O + p, T.DOMAIN, O + d)
    add(O + "name", T.SUB_PROPERTY, T.LABEL)
    add(O + "title", T.SUB_PROPERTY, O + "name")
    add(O + "by", T.INVERSE, O + "did")
    add(O + "name", T.DOMAIN, "_:u")
    add("_:u", T.OWL + "unionOf", "_:l1")
    for cell, member, rest in (("_:l1", "Person", "_:l2"), ("_:l2", "Work", "_:l3"), ("_:l3", "Organisation", None)):
        add(cell, T.RDF + "first", O + member)
        add(cell, T.RDF + "rest", rest or T.RDF + "nil")
    add(O + "partOf", T.TYPE, T.TRANSITIVE)
    add(O + "Person", T.DISJOINT, O + "Organisation")
    return spark.createDataFrame(rows, T.SCHEMA)


CLASS, PROP = EX + "class/", EX + "prop/"


def catalogue(table) -> DataFrame:
    """A schema that the tables make: brands are classes of parts and their types classes below them,
    the brands form a union by a list; nations are properties of a brand each, below those of regions,
    of which the first two are labels."""
    parts, brands = table("part").select("p_brand", "p_type").distinct(), table("part").select("p_brand").distinct()
    brand, leaf = F.concat(F.lit(CLASS), T.encode(F.col("p_brand"))), F.concat(F.lit(CLASS), T.encode(F.col("p_brand")), F.lit("/"), T.encode(F.col("p_type")))
    one = table("part").limit(1)
    tree = plain(parts, leaf, T.SUB_CLASS, brand).union(plain(brands, brand, T.SUB_CLASS, F.lit(O + "Part"))).union(plain(one, F.lit(O + "Part"), T.SUB_CLASS, F.lit(O + "Work")))
    names = plain(parts, leaf, T.LABEL, F.col("p_type"), "literal").union(plain(brands, brand, T.LABEL, F.col("p_brand"), "literal"))
    ranked = brands.withColumn("k", F.row_number().over(Window.orderBy("p_brand")))
    cell = lambda k: F.concat(F.lit("_:cell"), k.cast("string"))
    follows = ranked.withColumn("next", F.lead("k").over(Window.orderBy("k")))
    lists = plain(ranked, cell(F.col("k")), T.RDF + "first", brand).union(plain(follows.where("next IS NOT NULL"), cell(F.col("k")), T.RDF + "rest", cell(F.col("next")), "bnode")).union(plain(follows.where("next IS NULL"), cell(F.col("k")), T.RDF + "rest", F.lit(T.RDF + "nil")))
    union = plain(one, F.lit(O + "offered"), T.DOMAIN, F.lit("_:offers"), "bnode").union(plain(one, F.lit("_:offers"), T.OWL + "unionOf", F.lit("_:cell1"), "bnode"))
    nations, regions = table("nation"), table("region")
    prop, above = F.concat(F.lit(PROP), F.col("n_nationkey").cast("string")), lambda c: F.concat(F.lit(PROP + "region/"), F.col(c).cast("string"))
    kind = F.col("n_nationkey") % 3
    props = plain(nations, prop, T.DOMAIN, F.concat(F.lit(CLASS + "Brand%23"), (F.col("n_nationkey") + 1).cast("string"))).union(plain(nations, prop, T.SUB_PROPERTY, above("n_regionkey")))
    props = props.union(plain(nations.where(kind == 0), prop, T.RANGE, F.lit(T.XSD + "string"))).union(plain(nations.where(kind == 1), prop, T.RANGE, F.lit(O + "Type"))).union(plain(nations.where(kind > 0), prop, T.TYPE, F.lit(T.OWL + "ObjectProperty")))
    props = props.union(plain(regions.where("r_regionkey < 2"), above("r_regionkey"), T.SUB_PROPERTY, F.lit(T.LABEL))).union(plain(regions.where("r_regionkey = 1"), above("r_regionkey"), T.DOMAIN, F.lit(O + "Part")))
    return tree.union(names).union(lists).union(union).union(props)


def plain(df: DataFrame, s, p: str, o, kind: str = "uri") -> DataFrame:
    """One triple for each row."""
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))


_B = f"'{CLASS}' || replace(p_brand,'#','%23')"
_TREE = f"SELECT DISTINCT {_B} || '/' || p_type AS a, {_B} AS b FROM part UNION SELECT {_B}, '{O}Part' FROM part UNION SELECT '{O}Part', '{O}Work' FROM part"
_BRAND_OF = f"'{CLASS}Brand%23' || (n_nationkey + 1)"

# ------------------------------------------------------------------ patterns and joins


@query("""SELECT s_name AS name, count(*) AS credits FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY credits DESC, name""")
def q01_credits_per_person(spark, table):
    """Contributions counted by name over reified triples."""
    return ask(virtual(table, "credit", "person"), "SELECT ?name (COUNT(?c) AS ?credits) WHERE { ?c a o:Credit ; o:by ?p . ?p o:name ?name } GROUP BY ?name ORDER BY DESC(?credits) ?name")


@query("""SELECT DISTINCT c_name AS buyer, s_name AS supplier FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey""")
def q02_flagship_bridge(spark, table):
    """Two datasets of people joined through same-as links."""
    same = table("customer").join(table("supplier"), (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select("c_custkey", "s_suppkey")
    link = TripleMap("link", "same", EX + "customer/{c_custkey}", rules=(Rule(T.SAME_AS, iri=EX + "supplier/{s_suppkey}"),), key=("c_custkey",))
    data = virtual(table, "buyer", "person", "purchase")
    data = MappedGraph([*data.maps, link], data.sources | {"same": same}, MAPS)
    return ask(data, "SELECT DISTINCT ?buyer ?supplier WHERE { ?c owl:sameAs ?s . ?s o:name ?supplier . ?c o:name ?buyer . ?x o:buyer ?c }")


@query(f"""SELECT '{EX}part/' || p_partkey AS s, '{T.LABEL}' AS p, p_name AS o FROM part UNION SELECT '{EX}part/' || p_partkey, '{O}brand', '{EX}brand/' || replace(p_brand,'#','%23') FROM part
UNION SELECT '{EX}part/' || p_partkey, '{O}type', '{EX}type/' || replace(p_type,' ','%20') FROM part UNION SELECT '{EX}part/' || p_partkey, '{O}size', p_size::varchar FROM part
UNION SELECT '{EX}part/' || p_partkey, '{O}big', CASE WHEN p_size>25 THEN '1' ELSE 'false' END FROM part UNION SELECT '{EX}part/' || p_partkey, '{T.TYPE}', '{O}Part' FROM part""")
def q03_map_part_triples(spark, table):
    return graph(table, "part").select("s", "p", "o")


@query(f"""SELECT p, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l, (VALUES ('{T.TYPE}'),('{O}by'),('{O}involves'),('{O}order')) v(p) GROUP BY p""")
def q04_map_lineitem_reified(spark, table):
    """Triples of a reified relation counted by predicate: a pattern of variables alone."""
    return ask(virtual(table, "credit"), "SELECT ?p (COUNT(*) AS ?n) WHERE { ?c ?p ?o } GROUP BY ?p")


@query(f"""SELECT '{EX}o/' || o_orderkey AS s, '{O}late' AS p, o_orderpriority AS o FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' UNION SELECT '{EX}o/' || o_orderkey, '{T.TYPE}', '{O}Open' FROM orders WHERE o_orderstatus <> 'F'""")
def q05_conditional_emit(spark, table):
    """A condition on the subject and another on one rule."""
    m = TripleMap("open", "orders", EX + "o/{o_orderkey}", (O + "Open",), when="o_orderstatus <> 'F'", rules=(Rule(O + "late", column="o_orderpriority", when="o_orderpriority <> '5-LOW'"),))
    return mapping.apply(m, {"orders": table("orders")}).select("s", "p", "o")


@query("""WITH k AS (SELECT p_brand AS b, min(p_type) AS t FROM part GROUP BY 1), l AS (SELECT b, t, 'exact-' || b AS r FROM k UNION ALL SELECT b, '', 'general-' || b FROM k WHERE b < 'Brand#4')
SELECT p_partkey, coalesce(nullif(e.r,''), g.r, '') AS resolved FROM part LEFT JOIN l e ON p_brand=e.b AND p_type=e.t LEFT JOIN l g ON p_brand=g.b AND g.t=''""")
def q06_composite_fallback_lookup(spark, table):
    k = table("part").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    look = k.withColumn("r", F.concat(F.lit("exact-"), "p_brand")).unionByName(k.where("p_brand < 'Brand#4'").select("p_brand", F.lit("").alias("p_type"), F.concat(F.lit("general-"), "p_brand").alias("r")))
    return prepare.resolve_roles(table("part"), look, "p_brand", "p_type", "r").select("p_partkey", "resolved")


@query(f"""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey < 3 THEN '{EX}x/' || n_nationkey END, '{EX}iso/' || replace(n_name,' ','%20')) AS iri FROM nation""")
def q07_lookup_or_mint(spark, table):
    n = table("nation")
    look = n.where("n_nationkey < 3").select("n_nationkey", F.concat(F.lit(EX + "x/"), F.col("n_nationkey").cast("string")).alias("known"))
    return n.join(F.broadcast(look), "n_nationkey", "left").select("n_nationkey", F.coalesce("known", F.concat(F.lit(EX + "iso/"), T.encode(F.col("n_name")))).alias("iri"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def q08_anti_join(spark, table):
    return prepare.missing_keys(table("customer").select(F.col("c_custkey").alias("o_custkey")), table("orders").where("o_orderpriority LIKE '1%'"), "o_custkey").select(F.col("o_custkey").cast("long").alias("c_custkey"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def q09_semi_join(spark, table):
    return table("supplier").join(table("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")


@query("SELECT c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
def q10_not_exists(spark, table):
    return ask(virtual(table, "buyer", "purchase"), "SELECT ?name WHERE { ?c a o:Person ; o:name ?name FILTER NOT EXISTS { ?x o:buyer ?c ; o:year \"1995\" } }")


@query("SELECT p_partkey, w AS token FROM (SELECT p_partkey, unnest(string_split(p_name,' ')) AS w FROM part) WHERE trim(w) <> ''")
def q11_explode_tokens(spark, table):
    return prepare.explode_list(table("part"), "p_name", " ", "token").select("p_partkey", "token")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name,' '), lambda x: upper(trim(x))), '; ') AS names FROM part")
def q12_split_transform(spark, table):
    return table("part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), lambda x: F.upper(F.trim(x))), "; ").alias("names"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'WorkSeries' WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'WorkUnit' WHEN n_regionkey::varchar IN ('4','7') THEN 'WorkSeries' ELSE 'CreativeWork' END AS class FROM nation) GROUP BY class""")
def q13_structure_case(spark, table):
    n = table("nation")
    s = table("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("a")).distinct()
    c = table("customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("b")).distinct()
    flags = n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    kind = prepare.structure_class(F.col("n_regionkey").cast("string"), F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False)))
    return flags.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ paths and inference


@query(f"""WITH RECURSIVE e(a,b) AS ({_TREE}), n(x) AS (SELECT a FROM e UNION SELECT b FROM e), r(a,b) AS (SELECT x, x FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a) SELECT a AS c, b AS d FROM r""")
def q14_path_star(spark, table):
    """Every class with itself and all above it."""
    return ask(catalogue(table).where(F.col("p") == T.SUB_CLASS), "SELECT DISTINCT ?c ?d WHERE { ?c rdfs:subClassOf* ?d }")


@query("""WITH RECURSIVE e(a,b) AS (SELECT DISTINCT n_nationkey, (n_nationkey*7+3)%25 FROM nation), r(a,b) AS (SELECT a,b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a) SELECT a::bigint AS a, b::bigint AS b FROM r""")
def q15_path_plus_cyclic(spark, table):
    e = table("nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("b"))
    return reason.closure(e).select("a", "b")


@query(f"SELECT DISTINCT {_B} AS member FROM part")
def q16_union_list_walk(spark, table):
    """The members of a union, along its list."""
    return ask(catalogue(table), "SELECT DISTINCT ?member WHERE { o:offered rdfs:domain ?d . ?d owl:unionOf/rdf:rest*/rdf:first ?member }")


@query(f"""SELECT '{O}' || c AS class, count(DISTINCT s) AS n FROM (SELECT s_suppkey AS s, c FROM supplier, (VALUES ('Person'),('Agent')) v(c) WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT s_suppkey, c FROM supplier, (VALUES ('Person'),('Agent'),('Supplier'),('_')) v(c) WHERE c<>'_' AND s_suppkey IN (SELECT l_suppkey FROM lineitem)) GROUP BY c""")
def q17_type_inference(spark, table):
    """Super-classes and ranges: who is a person, an agent, a supplier."""
    out = reason.infer(graph(table, "credit", "person").where(F.col("p").isin(T.TYPE, O + "by")), ontology(spark))
    kinds = out.where((F.col("p") == T.TYPE) & F.col("o").isin(O + "Person", O + "Agent", O + "Supplier"))
    return kinds.groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n"))


@query(f"""SELECT '{EX}supplier/' || s_suppkey AS s, s_name AS label FROM supplier""")
def q18_subproperty_label(spark, table):
    out = reason.infer(graph(table, "person"), ontology(spark))
    return out.where(F.col("p") == T.LABEL).join(table("supplier").select(F.col("s_name").alias("o")), "o", "left_semi").select("s", F.col("o").alias("label"))


@query(f"""SELECT DISTINCT '{EX}part/' || l_partkey AS s FROM lineitem""")
def q19_domain_range(spark, table):
    """Parts known only from the range of a property."""
    out = reason.infer(graph(table, "credit").where(F.col("p") == O + "involves"), ontology(spark))
    return out.where((F.col("p") == T.TYPE) & (F.col("o") == O + "Part")).select("s")


@query(f"""SELECT '{EX}supplier/' || l_suppkey AS s, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY 1""")
def q20_inverse(spark, table):
    out = reason.infer(graph(table, "credit").where(F.col("p") == O + "by"), ontology(spark))
    return out.where(F.col("p") == O + "did").groupBy("s").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e(a,b) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), r(a,b) AS (SELECT * FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a) SELECT a, b FROM r""")
def q21_transitive(spark, table):
    n = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table("customer").select(n("c_custkey", "c").alias("a"), n("c_nationkey", "n").alias("b")).union(table("nation").select(n("n_nationkey", "n"), n("n_regionkey", "r")))
    return reason.closure(e).select("a", "b")


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier), g(a,b) AS (SELECT a,b FROM e UNION SELECT b,a FROM e), r(a,b) AS (SELECT a,a FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b=g.a) SELECT a AS id, min(b) AS canonical FROM r GROUP BY a""")
def q22_sameas_components(spark, table):
    e = table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("b"))
    return reason.components(e)


@query(f"""SELECT 'disjoint' AS rule, '{EX}supplier/' || s_suppkey AS s, '{O}Person {O}Organisation' AS detail FROM supplier WHERE s_acctbal < 0""")
def q23_consistency_disjoint(spark, table):
    bad = table("supplier").where("s_acctbal < 0").select(F.concat(F.lit(EX + "supplier/"), F.col("s_suppkey").cast("string")).alias("s"), F.lit(T.TYPE).alias("p"), F.lit(O + "Organisation").alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return reason.violations(graph(table, "person").unionByName(bad), ontology(spark))


# ------------------------------------------------------------------ faceted search

BRANDS = ("Brand#11", "Brand#12", "Brand#23")
_BRAND_IRIS = tuple(EX + "brand/" + b.replace("#", "%23") for b in BRANDS)
STATE = facets.State(O + "Part", facets=(facets.Facet(O + "brand", "enum", _BRAND_IRIS), facets.Facet(O + "size", "integer", low=5, high=40)))
_HIT = "p_brand IN ('Brand#11','Brand#12','Brand#23') AND p_size BETWEEN 5 AND 40"


@query(f"SELECT '{EX}part/' || p_partkey AS work, p_name AS label FROM part WHERE {_HIT} ORDER BY label, work LIMIT 50")
def q24_facet_page(spark, table):
    return facets.page(graph(table, "part"), STATE, [T.LABEL])


@query(f"SELECT count(*) AS total, count(*) > 1000 AS capped FROM part WHERE {_HIT}")
def q25_facet_total(spark, table):
    return facets.total(graph(table, "part"), STATE, [T.LABEL])


@query(f"""SELECT '{O}brand' AS prop, '{EX}brand/' || replace(p_brand,'#','%23') AS value, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 40 GROUP BY 2
UNION ALL SELECT '{O}type', '{EX}type/' || replace(p_type,' ','%20'), count(*) FROM part WHERE {_HIT} GROUP BY 2""")
def q26_facet_counts_selfexcl(spark, table):
    return facets.counts(graph(table, "part"), STATE, [O + "brand", O + "type"], [T.LABEL])


@query(f"""SELECT b AS label, count(p_partkey) AS n FROM (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN (SELECT * FROM part WHERE p_size > 49 AND p_type IN (SELECT min(p_type) FROM part)) p ON b = p_brand GROUP BY b""")
def q27_facet_counts_zero(spark, table):
    least = table("part").agg(F.min("p_type")).first()[0]
    state = facets.State(O + "Part", facets=(facets.Facet(O + "size", "integer", low=50), facets.Facet(O + "type", "enum", (EX + "type/" + (least or "").replace(" ", "%20"),))))
    values = table("part").select(F.lit(O + "brand").alias("prop"), F.concat(F.lit(EX + "brand/"), T.encode(F.col("p_brand"))).alias("value"), F.col("p_brand").alias("label")).distinct()
    return facets.counts_with_zero(values, facets.counts(graph(table, "part"), state, [O + "brand"], [T.LABEL])).select("label", "n")


@query("SELECT min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders")
def q28_year_bounds(spark, table):
    g = graph(table, "purchase")
    return facets.bounds(g, facets.instances(g, O + "Order"), O + "year")


@query(f"SELECT '{EX}part/' || p_partkey AS work FROM part WHERE contains(lower(p_name), 'wid') AND p_brand = 'Brand#11'")
def q29_text_search(spark, table):
    state = facets.State(O + "Part", q=" WID ", facets=(facets.Facet(O + "brand", "enum", (_BRAND_IRIS[0],)),))
    return facets.matches(graph(table, "part"), state, [T.LABEL])


@query(f"SELECT '{EX}part/' || p_partkey AS work FROM part WHERE p_size > 25")
def q30_bool_filter(spark, table):
    return facets.matches(graph(table, "part"), facets.State(O + "Part", facets=(facets.Facet(O + "big", "boolean", value="true"),)), [T.LABEL])


@query(f"""SELECT '{O}from' AS prop, true AS is_object, n_name AS shown FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE s_suppkey = 1""")
def q31_card(spark, table):
    g = graph(table, "person", "nation")
    out = facets.card(g, EX + "supplier/1", [T.LABEL, O + "name"])
    return out.select("prop", "is_object", F.array_join("vals", "; ").alias("shown"))


@query(f"""SELECT '{PROP}' || n_nationkey AS prop, CASE n_nationkey % 3 WHEN 0 THEN '{T.XSD}string' WHEN 1 THEN '{O}Type' END AS range, n_nationkey % 3 > 0 AS is_object FROM nation WHERE {_BRAND_OF} IN (SELECT {_B} FROM part)
UNION ALL SELECT '{PROP}region/1', NULL, false FROM region WHERE r_regionkey = 1 UNION ALL SELECT '{O}offered', NULL, false FROM (SELECT 1 FROM part LIMIT 1)""")
def q32_discover_properties(spark, table):
    """Properties of parts, of the classes above and below them, and of a union with such a member."""
    return facets.properties(catalogue(table), O + "Part")


@query(f"""SELECT '{PROP}' || n_nationkey AS prop, 2 AS depth FROM nation WHERE n_regionkey < 2 AND {_BRAND_OF} IN (SELECT {_B} FROM part) UNION ALL SELECT '{PROP}region/1', 1 FROM region WHERE r_regionkey = 1 UNION ALL SELECT '{T.LABEL}', 1048576 FROM (SELECT 1 FROM part LIMIT 1)""")
def q33_label_props(spark, table):
    """Properties of parts below rdfs:label, by their distance."""
    return facets.label_properties(catalogue(table), O + "Part")


@query(f"SELECT '{EX}region/' || r_regionkey AS value, r_name AS label FROM region")
def q34_enum_values(spark, table):
    return facets.enum_values(graph(table, "region"), O + "Region")


# ------------------------------------------------------------------ entities and scalars

_RAW = "CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'fl. ' || y WHEN 2 THEN '19th century' WHEN 3 THEN 'active 1900s' WHEN 4 THEN 'unknown' WHEN 5 THEN y WHEN 6 THEN 'ca. ' || y WHEN 7 THEN y || '?' WHEN 8 THEN '26 February ' || y ELSE '2150' END"


@query(f"""SELECT outcome, year, count(*) AS n FROM (SELECT outcome, CASE WHEN outcome IN ('clean','uncertain','extracted') THEN regexp_extract(raw,'(1[0-9]{{3}}|2[01][0-9]{{2}})',1)::int END AS year FROM
(SELECT raw, CASE WHEN raw='' THEN 'absent' WHEN raw LIKE 'fl.%' THEN 'floruit' WHEN raw LIKE '%century' THEN 'century' WHEN raw LIKE '%1900s' THEN 'decade' WHEN raw='unknown' THEN 'unparseable' WHEN regexp_full_match(raw,'[0-9]{{4}}') THEN 'clean' WHEN raw LIKE 'ca.%' OR raw LIKE '%?' THEN 'uncertain' ELSE 'extracted' END AS outcome
FROM (SELECT {_RAW} AS raw FROM (SELECT o_orderkey, year(o_orderdate)::varchar AS y FROM orders)))) GROUP BY 1, 2""")
def q35_parse_year_outcomes(spark, table):
    raw = table("orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y")).select(F.expr(_RAW).alias("raw"))
    year, outcome = scalar.parse_year(F.col("raw"))
    return raw.select(outcome.alias("outcome"), year.alias("year")).groupBy("outcome", "year").agg(F.count("*").alias("n"))


def _people(table):
    """Two lists of people: parts' names stand for names, sizes for years."""
    toks = scalar.tokens(scalar.squeeze(F.col("p_name")))
    birth = (F.lit(1800) + F.col("p_size")).cast("int")
    base = table("part").select(F.col("p_partkey").alias("id"), toks.alias("tokens"), "p_size", birth.alias("b"))
    left = base.where("id % 2 = 0").select("id", "tokens", F.when(F.col("p_size") % 5 != 0, F.col("b")).alias("birth"), F.lit(None).cast("int").alias("death"))
    right = base.where("id % 2 = 1").select("id", "tokens", F.array().cast("array<array<string>>").alias("alternates"), F.when(F.col("p_size") % 7 != 0, F.col("b")).alias("birth"), F.lit(None).cast("int").alias("death"), F.when(F.col("p_size") % 3 == 0, "clean").otherwise("uncertain").alias("birth_outcome"))
    return left, right


_ER = """b AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name),' ')) AS t, p_size AS z, 1800+p_size AS y FROM part), c AS (SELECT l.id AS left_id, r.id AS right_id, l.t AS lt, r.t AS rt, CASE WHEN l.z%5<>0 THEN l.y END AS ly, CASE WHEN r.z%7<>0 THEN r.y END AS ry, r.z%3=0 AS clean
FROM b l JOIN b r ON l.id%2=0 AND r.id%2=1 AND len(list_filter(list_intersect(l.t,r.t), lambda x: len(x)>=4))>0),
j AS (SELECT left_id, right_id, lt, rt, abs(ly-ry)<=3 AS d, clean, (len(list_intersect(lt,rt))>=2 OR len(list_intersect(lt,rt))=len(lt) OR len(list_intersect(lt,rt))=len(rt)) AS m FROM c)"""


@query(f"WITH {_ER} SELECT left_id, right_id FROM c")
def q36_er_blocking(spark, table):
    """Every pair of people that share a token; names meet, and their bearers are dealt to a grid."""
    return entity.block(*_people(table))


@query(f"WITH {_ER} SELECT left_id, right_id, CASE WHEN m AND d AND clean THEN 'high' WHEN m AND d THEN 'medium' WHEN m AND d IS NULL THEN 'low' END AS confidence FROM j")
def q37_er_confidence(spark, table):
    """The confidence of every candidate pair of people; names are judged once for all who bear them."""
    return entity.judged(*_people(table)).select("left_id", "right_id", "confidence")


@query(f"WITH {_ER} SELECT left_id AS id, count(*) AS n_candidates FROM c GROUP BY left_id")
def q84_er_candidate_counts(spark, table):
    """How many people on the right share a token with each on the left; names meet, not people."""
    return entity.candidate_counts(*_people(table))


@query(f"""WITH {_ER}, lc AS (SELECT list_sort(t) AS k, min(id) AS c FROM b WHERE id%2=0 GROUP BY 1), rc AS (SELECT list_sort(t) AS k, min(id) AS c FROM b WHERE id%2=1 GROUP BY 1)
SELECT lc.c AS left_class, rc.c AS right_class, CASE WHEN d THEN 'confirmed' WHEN d IS NULL THEN 'inconclusive' ELSE 'rejected' END AS outcome, CASE WHEN d AND clean THEN 'high' WHEN d THEN 'medium' WHEN d IS NULL THEN 'low' END AS confidence, count(*) AS pairs
FROM j JOIN lc ON list_sort(lt) = lc.k JOIN rc ON list_sort(rt) = rc.k WHERE m GROUP BY ALL""")
def q85_er_class_outcomes(spark, table):
    """Outcomes of matching names, counted over the pairs of people who bear them."""
    return entity.outcomes(*_people(table))


@query(f"WITH {_ER} SELECT count(*) AS candidates, count(*) FILTER (d) AS confirmed, count(*) FILTER (d IS NULL) AS inconclusive, count(*) FILTER (NOT d) AS rejected, count(*) FILTER (d IS NULL OR d) AS asserted FROM j WHERE m")
def q38_er_metrics(spark, table):
    return entity.funnel_of(entity.outcomes(*_people(table)))


@query("SELECT event_id, coalesce(json_extract_string(props,'$.k'),'') AS k FROM events")
def q39_json_extract(spark, table):
    return table("events").select("event_id", F.coalesce(F.from_json("props", "k string")["k"], F.lit("")).alias("k"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def q40_first_wins_dedup(spark, table):
    return prepare.first_wins(table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT t AS work_type, count(*) AS n FROM (SELECT CASE WHEN contains(x,'short stor') THEN 'ShortStory' WHEN contains(x,'essay') THEN 'Essay' WHEN contains(x,'poetry') OR contains(x,'poesia') OR contains(x,'poems') OR contains(x,'poésie') THEN 'Poetry' WHEN contains(x,'drama') OR contains(x,'play') OR contains(x,'theater') OR contains(x,'theatre') THEN 'Play' WHEN contains(x,'fiction') OR contains(x,'novel') OR contains(x,'roman') THEN 'Novel' ELSE 'NonFiction' END AS t
FROM (SELECT lower(CASE o_orderkey%6 WHEN 0 THEN 'Nonfiction' WHEN 1 THEN 'A display' WHEN 2 THEN 'Short Stories' WHEN 3 THEN 'Essays' WHEN 4 THEN 'Poésie' ELSE 'History' END) AS x FROM orders)) GROUP BY t""")
def q41_worktype_classify(spark, table):
    x = F.expr("CASE o_orderkey%6 WHEN 0 THEN 'Nonfiction' WHEN 1 THEN 'A display' WHEN 2 THEN 'Short Stories' WHEN 3 THEN 'Essays' WHEN 4 THEN 'Poésie' ELSE 'History' END")
    return table("orders").groupBy(scalar.work_type(x).alias("work_type")).agg(F.count("*").alias("n"))


@query("""SELECT c, CASE WHEN len(c)=2 THEN 'i1/'||c WHEN len(c)=3 THEN 'i3/'||c END AS by_length, CASE WHEN substr(c,1,2)=c THEN 'i1/'||c ELSE 'i3/'||c END AS by_branch FROM (SELECT DISTINCT substr(n_name,1,1+n_nationkey%4) AS c FROM nation)""")
def q42_language_branch(spark, table):
    c = table("nation").select(F.expr("substr(n_name, 1, 1 + n_nationkey % 4)").alias("c")).distinct()
    return c.select("c", scalar.language_iri(F.col("c"), "i1/", "i3/").alias("by_length"), scalar.language_branch(F.col("c"), "i1/", "i3/").alias("by_branch"))


# ------------------------------------------------------------------ optional, union, federation


@query(f"""SELECT '{EX}supplier/' || s_suppkey AS s, CASE WHEN contains(n_name,'A') THEN n_name END AS label FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey""")
def q43_optional_filter_inside(spark, table):
    return ask(virtual(table, "person", "nation"), 'SELECT ?s ?label WHERE { ?s o:name ?n OPTIONAL { ?s o:from ?c . ?c rdfs:label ?label FILTER(CONTAINS(STR(?label), "A")) } }')


@query(f"""SELECT '{EX}nation/' || n_nationkey AS x, n_name AS a, NULL AS b FROM nation UNION ALL SELECT '{EX}supplier/' || s_suppkey, NULL, s_name FROM supplier""")
def q44_union_missing_vars(spark, table):
    return ask(virtual(table, "person", "nation"), "SELECT ?x ?a ?b WHERE { { ?x a o:Nation . ?x rdfs:label ?a } UNION { ?x o:name ?b } }")


@query(f"""SELECT s_name AS name, '{EX}supplier/' || s_suppkey AS p FROM supplier WHERE s_suppkey IN (1,3,5)""")
def q45_values_bindjoin(spark, table):
    ids = " ".join(f"<{EX}supplier/{k}>" for k in (1, 3, 5))
    return ask(virtual(table, "person"), f"SELECT ?name ?p WHERE {{ VALUES ?p {{ {ids} }} ?p o:name ?name }}")


@query("""SELECT DISTINCT s_name AS name, n_name AS label FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE starts_with(n_name, 'NATION_1')""")
def q46_service_two_datasets(spark, table):
    sets = {"": virtual(table, "person"), EX + "nations": virtual(table, "nation")}
    return ask(sets, f'SELECT DISTINCT ?name ?label WHERE {{ ?p o:name ?name ; o:from ?n . SERVICE <{EX}nations> {{ ?n rdfs:label ?label FILTER(STRSTARTS(STR(?label), "NATION_1")) }} }}')


@query("""SELECT s_name AS name, count(*) AS credits FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1""")
def q47_blind_optional(spark, table):
    """An optional service block that matches nothing leaves bag counts as they are."""
    sets = {"": virtual(table, "credit", "person"), EX + "books": virtual(table, "region")}
    return ask(sets, f"SELECT ?name (COUNT(?c) AS ?credits) WHERE {{ ?c o:by ?p . ?p o:name ?name OPTIONAL {{ SERVICE <{EX}books> {{ ?p a o:Book }} }} }} GROUP BY ?name")


@query("""SELECT 'orders' AS "check", count(*) AS missing, min(k) AS example FROM (SELECT DISTINCT c_custkey::varchar AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'nations', count(*), min(k) FROM (SELECT DISTINCT s_nationkey::varchar AS k FROM supplier WHERE s_nationkey <> 3 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 1))""")
def q48_coverage_report(spark, table):
    text = lambda c: F.col(c).cast("string").alias("k")
    return prepare.coverage_report({"orders": (table("customer").select(text("c_custkey")), table("orders").select(text("o_custkey")), "k", []), "nations": (table("supplier").select(text("s_nationkey")), table("nation").where("n_regionkey > 1").select(text("n_nationkey")), "k", ["3"])})


@query("SELECT count(*) AS rows, count(*) = (SELECT count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)) AS equal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q49_set_equality_oracle_check(spark, table):
    """Two strategies give the same rows: a declared join and a bind join."""
    s, n = table("supplier").select("s_name", F.col("s_nationkey").alias("k")), table("nation").select("n_name", F.col("n_nationkey").alias("k"))
    bound = federation.bind_join(s, n, "k").select("s_name", "n_name")
    return prepare.same_rows(s.join(n, "k").select("s_name", "n_name"), bound).crossJoin(bound.agg(F.count("*").alias("rows"))).select("rows", "equal")


@query(f"""SELECT 'bridge' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'rest', count(n_nationkey) + count(n_name) + count(DISTINCT n_nationkey) FROM nation""")
def q50_graph_split(spark, table):
    g = graph(table, "person", "nation")
    touch, rest = prepare.split_graph(g, EX + "supplier/")
    return touch.where(F.col("p") == O + "name").agg(F.lit("bridge").alias("part"), F.count("*").alias("n")).unionByName(rest.agg(F.lit("rest").alias("part"), F.count("*").alias("n")))


@query(f"""SELECT p, count(*) AS n, sum(length(o))::bigint AS chars FROM (SELECT '{T.LABEL}' AS p, p_name AS o FROM part UNION ALL SELECT '{O}brand', '{EX}brand/' || replace(p_brand,'#','%23') FROM part UNION ALL SELECT '{O}type', '{EX}type/' || p_type FROM part
UNION ALL SELECT '{O}size', p_size::varchar FROM part UNION ALL SELECT '{O}big', CASE WHEN p_size > 25 THEN '1' ELSE 'false' END FROM part UNION ALL SELECT '{T.TYPE}', '{O}Part' FROM part) GROUP BY p""")
def q51_ntriples_round_trip(spark, table):
    """Triples written as text, read back and loaded beside the original: nothing is new, nothing changed."""
    g = graph(table, "part")
    cat = Catalog()
    cat.load("a", g)
    cat.load("a", parse_ntriples(format_ntriples(g)))
    return cat["a"].groupBy("p").agg(F.count("*").alias("n"), F.sum(F.length("o")).alias("chars"))


@query('SELECT column_name AS "column", n FROM (SELECT count(*) FILTER (o_orderstatus = \'F\') AS o_orderstatus, 0::bigint AS o_orderpriority FROM orders) UNPIVOT (n FOR column_name IN (o_orderstatus, o_orderpriority))')
def q52_null_counts(spark, table):
    df = table("orders").select(F.when(F.col("o_orderstatus") == "F", T.NULL_MARK).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return prepare.null_counts(df)


@query(f"SELECT DISTINCT {_B} || '/' || p_type AS iri, p_type AS label FROM part UNION SELECT {_B}, p_brand FROM part UNION SELECT '{O}Part', 'Part' FROM part")
def q53_discover_classes(spark, table):
    return facets.classes(catalogue(table), O + "Part")


@query("SELECT count(*) > 0 AS answer FROM region")
def q54_ask(spark, table):
    return ask(virtual(table, "region"), "ASK { ?x a o:Region }")


@query("SELECT count(DISTINCT l_suppkey) AS n, min(l_linenumber)::varchar AS low, max(l_linenumber)::varchar AS high FROM lineitem")
def q55_aggregates(spark, table):
    return ask(virtual(table, "credit"), "SELECT (COUNT(DISTINCT ?p) AS ?n) (MIN(?o) AS ?low) (MAX(?o) AS ?high) WHERE { ?c o:by ?p ; o:order ?o }")


@query("SELECT p_name AS name, p_size::varchar AS size FROM part WHERE p_size >= 45 AND p_size <> 47 ORDER BY name, p_partkey")
def q56_filter_numeric(spark, table):
    return ask(virtual(table, "part"), "SELECT ?name ?size WHERE { ?x rdfs:label ?name ; o:size ?size FILTER(?size >= 45 && !(?size = 47)) } ORDER BY ?name")


@query("""SELECT n_name AS work FROM nation WHERE false UNION ALL SELECT DISTINCT n_name FROM nation JOIN supplier ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name IN ('ASIA','EUROPE')""")
def q57_path_sequence(spark, table):
    data = virtual(table, "person", "nation", "region")
    return ask(data, 'SELECT DISTINCT ?work WHERE { ?s o:from ?n . ?n rdfs:label ?work ; o:partOf/rdfs:label ?r FILTER(?r IN ("ASIA", "EUROPE")) }')


@query("""SELECT s_nationkey AS k, count(*) AS n FROM (SELECT DISTINCT least(s_suppkey, coalesce(c_custkey, s_suppkey)) AS i, s_nationkey FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey) GROUP BY 1""")
def q58_canonicalise(spark, table):
    """Same-as members counted once: persons by nation after canonical ids replace theirs."""
    n = lambda p, c: F.concat(F.lit(EX + p), F.col(c).cast("string"))
    links = table("supplier").join(table("customer"), F.col("s_suppkey") == F.col("c_custkey")).select(n("supplier/", "s_suppkey").alias("a"), n("customer/", "c_custkey").alias("b"))
    facts = table("supplier").select(n("supplier/", "s_suppkey").alias("s"), F.lit(O + "k").alias("p"), F.col("s_nationkey").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    out = reason.canonicalise(facts, reason.components(links))
    return out.groupBy(F.col("o").cast("int").alias("k")).agg(F.countDistinct("s").alias("n"))


# ------------------------------------------------------------------ vocabularies, limits, curation


@query("SELECT 'http://example.org/onto#' || r AS range, count(b) > 0 AS is_vocabulary FROM (VALUES ('Brand'), ('Type')) v(r) LEFT JOIN (SELECT DISTINCT 'Brand' AS k, p_brand AS b FROM part) ON k = r GROUP BY r")
def q59_vocabularies(spark, table):
    """Brands are named individuals of their class, types are not."""
    brand, kind = F.concat(F.lit(EX + "brand/"), "p_brand"), F.concat(F.lit(EX + "type/"), "p_type")
    parts = table("part")
    schema = plain(parts, brand, T.TYPE, F.lit(O + "Brand")).union(plain(parts, brand, T.TYPE, F.lit(T.NAMED_INDIVIDUAL))).union(plain(parts, kind, T.TYPE, F.lit(O + "Type")))
    return facets.vocabularies(schema, spark.createDataFrame([(O + "Brand",), (O + "Type",)], "range string"))


@query("SELECT 'maximum' AS rule, 'http://example.org/customer/' || o_custkey AS s, 'http://example.org/onto#placed' AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 15")
def q60_over_maximum(spark, table):
    """Buyers with more than fifteen orders, where their class allows no more."""
    orders = table("orders")
    buyer = F.concat(F.lit(EX + "customer/"), F.col("o_custkey").cast("string"))
    data = plain(orders, buyer, O + "placed", F.concat(F.lit(EX + "order/"), F.col("o_orderkey").cast("string"))).union(plain(orders, buyer, T.TYPE, F.lit(O + "Buyer")))
    rule = [(O + "Buyer", T.SUB_CLASS, "_:r", "bnode", ""), ("_:r", T.OWL + "onProperty", O + "placed", "uri", ""), ("_:r", T.OWL + "maxCardinality", "15", "literal", T.XSD + "integer")]
    schema = spark.createDataFrame([(*r, "") for r in rule], "s string, p string, o string, o_kind string, o_dt string, o_lang string")
    return reason.over_maximum(data, schema)


@query("SELECT DISTINCT p_brand AS value, lower(p_brand) AS label FROM part WHERE contains(lower(p_brand), '#1')")
def q61_search_values(spark, table):
    values = table("part").select(F.col("p_brand").alias("value"), F.lower("p_brand").alias("label")).distinct()
    return facets.search_values(values, "#1")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 25 AND p_brand IN ('Brand#13', 'Brand#24', 'Brand#31')")
def q62_curated(spark, table):
    """Parts marked yes, of chosen brands, with high confidence."""
    marked = table("part").select("*", F.when(F.col("p_size") > 25, " Yes").otherwise("no").alias("keep"), F.lit("high").alias("confidence"))
    return prepare.curated(prepare.kept(marked), "p_brand", ["Brand#13", "Brand#24", "Brand#31"]).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(f"""WITH p AS (SELECT '{PROP}' || n_nationkey AS prop, {_BRAND_OF} AS brand FROM nation), known AS (SELECT DISTINCT {_B} AS brand FROM part)
SELECT prop, brand AS domain FROM p UNION SELECT prop, '{O}Part' FROM p WHERE brand IN (SELECT brand FROM known) UNION SELECT prop, '{O}Work' FROM p WHERE brand IN (SELECT brand FROM known)
UNION SELECT '{PROP}region/1', d FROM region, (VALUES ('{O}Part'), ('{O}Work')) v(d) WHERE r_regionkey = 1 UNION SELECT '{PROP}' || n_nationkey, d FROM nation, (VALUES ('{O}Part'), ('{O}Work')) v(d) WHERE n_regionkey = 1 UNION SELECT '{O}offered', '_:offers' FROM part""")
def q63_lifted_domains(spark, table):
    """Domains of a property hold for its sub-properties, and their super-classes are domains too."""
    return reason.lifted_schema(catalogue(table)).where(F.col("p") == T.DOMAIN).select(F.col("s").alias("prop"), F.col("o").alias("domain"))


# ------------------------------------------------------------------ equality, seeded paths, strategies

_SAME = """e AS (SELECT 'customer/' || c_custkey AS a, 'supplier/' || s_suppkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey UNION SELECT 'supplier/' || x.s_suppkey, 'supplier/' || y.s_suppkey FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 AND x.s_nationkey % 3 = y.s_nationkey % 3),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)"""


def _same_people(table) -> DataFrame:
    """Same-as links: a customer and a supplier of one number, and suppliers in a row of like nations."""
    c, s = table("customer"), table("supplier")
    name = lambda kind, col: F.concat(F.lit(f"{EX}{kind}/"), F.col(col).cast("string"))
    after = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("next"), F.col("s_nationkey").alias("nation"))
    return plain(c.join(s, F.col("c_custkey") == F.col("s_suppkey")), name("customer", "c_custkey"), T.SAME_AS, name("supplier", "s_suppkey")).union(plain(s.join(after, "s_suppkey").where("s_nationkey % 3 = nation % 3"), name("supplier", "s_suppkey"), T.SAME_AS, name("supplier", "next")))


@query(f"""WITH RECURSIVE {_SAME} SELECT '{EX}' || r.a AS s, count(*) AS n FROM r JOIN orders ON r.b = 'customer/' || o_custkey WHERE r.a LIKE 'supplier%' GROUP BY 1""")
def q64_equality_inference(spark, table):
    """Orders that suppliers placed under any of their names: facts of one name are answered for the others."""
    bought = spark.createDataFrame([(O + "buyer", T.INVERSE, O + "bought", "uri", "", "")], T.SCHEMA)
    closed = reason.close(graph(table, "purchase").where(F.col("p") == O + "buyer").unionByName(_same_people(table)), bought)
    asked = table("supplier").select(F.concat(F.lit(EX + "supplier/"), F.col("s_suppkey").cast("string")).alias("name"))
    return closed.about(asked).where(F.col("p") == O + "bought").groupBy("s").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_SAME}, c AS (SELECT a, min('{EX}' || b) AS canonical FROM r GROUP BY a)
SELECT 'different' AS rule, least('{EX}supplier/' || s_suppkey, '{EX}supplier/' || (s_suppkey + 2)) AS s, greatest('{EX}supplier/' || s_suppkey, '{EX}supplier/' || (s_suppkey + 2)) AS detail FROM supplier JOIN r ON r.a = 'supplier/' || s_suppkey AND r.b = 'supplier/' || (s_suppkey + 2)
UNION SELECT 'disjoint', canonical, '{O}Vendor {O}Household' FROM c JOIN customer ON c.a = 'customer/' || c_custkey WHERE c_mktsegment = 'HOUSEHOLD'""")
def q65_equality_violations(spark, table):
    """Names said to differ that a chain of links makes one, and things of two disjoint classes under two names."""
    name = lambda kind, c: F.concat(F.lit(f"{EX}{kind}/"), c.cast("string"))
    s, c = table("supplier"), table("customer").where("c_mktsegment = 'HOUSEHOLD'")
    data = _same_people(table).union(plain(s, name("supplier", F.col("s_suppkey")), T.OWL + "differentFrom", name("supplier", F.col("s_suppkey") + 2)))
    data = data.union(plain(s, name("supplier", F.col("s_suppkey")), T.TYPE, F.lit(O + "Vendor"))).union(plain(c, name("customer", F.col("c_custkey")), T.TYPE, F.lit(O + "Household")))
    return reason.violations(data, spark.createDataFrame([(O + "Vendor", T.DISJOINT, O + "Household", "uri", "", "")], T.SCHEMA))


LIVES = TripleMap("lives", "customer", EX + "customer/{c_custkey}", rules=(Rule(O + "partOf", iri=EX + "nation/{c_nationkey}"),), key=("c_custkey",))


def _places(table) -> MappedGraph:
    """Customers within nations within regions."""
    base = virtual(table, "nation", "region", "purchase")
    return MappedGraph([*base.maps, LIVES], base.sources | {"customer": table("customer")}, MAPS)


@query(f"SELECT '{EX}customer/' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT '{EX}nation/' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT '{EX}region/2'")
def q66_path_from_constant(spark, table):
    """All that lies within one region, walked from that region alone."""
    return ask(_places(table), f"SELECT ?x WHERE {{ ?x o:partOf* <{EX}region/2> }}")


@query("SELECT r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(o_orderdate) = 1996 GROUP BY r_name")
def q67_path_from_solutions(spark, table):
    """Orders of a year by region: the path starts from those orders' buyers."""
    return ask(_places(table), 'SELECT ?region (COUNT(?x) AS ?orders) WHERE { ?x o:year "1996"^^xsd:gYear ; o:buyer ?c . ?c o:partOf+ ?r . ?r a o:Region ; rdfs:label ?region } GROUP BY ?region')


@query("SELECT strategy, CASE WHEN strategy = 'blind' THEN 0 ELSE n END AS rows, strategy <> 'blind' OR n = 0 AS equal FROM (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l JOIN part ON l_partkey = p_partkey), (VALUES ('single'), ('naive'), ('optimised'), ('nested'), ('blind')) v(strategy)")
def q68_strategies(spark, table):
    """One question over two datasets under five strategies, each counted and hashed where its rows are."""
    credits, parts = virtual(table, "credit"), virtual(table, "part")
    both = MappedGraph([*credits.maps, *parts.maps], credits.sources | parts.sources, MAPS)
    sets = {"": both, EX + "credits": credits, EX + "parts": parts}
    what = "?c o:involves ?w . ?w rdfs:label ?name"
    in_ = lambda name, text: ask({"": sets[EX + name]}, text)
    inside = lambda text: ask(sets | {"": credits}, f"SELECT ?c ?w ?name WHERE {{ {text} }}")
    found = federation.run(federation.strategies(
        in_("credits", "SELECT ?c ?w WHERE { ?c o:involves ?w }"), in_("parts", "SELECT ?w ?name WHERE { ?w rdfs:label ?name }"), "w",
        single=lambda: ask({"": both}, f"SELECT ?c ?w ?name WHERE {{ {what} }}"), nested=lambda: inside(f"?c o:involves ?w . SERVICE <{EX}parts> {{ ?w rdfs:label ?name }}"), blind=lambda: inside(what),
    ), "single", spark)
    return federation.table(spark, found).select("strategy", "rows", "equal")


# ------------------------------------------------------------------ sources, filters and rules one by one


def _scratch(spark) -> str:
    """A fresh folder name in the session's shared checkpoint folder."""
    reason.cut(spark.range(1))  # sets one where there is none
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("SELECT c_custkey::varchar AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'says \"hi\", twice' ELSE c_mktsegment END AS segment FROM customer")
def q69_csv_round_trip(spark, table):
    """A relation written as CSV and scanned again: quotes, separators, empty cells."""
    path = _scratch(spark)
    files.write_csv(table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'says \"hi\", twice' ELSE c_mktsegment END").alias("segment")), path)
    return files.read_csv(spark, path, ["id", "name", "segment"])


@query("SELECT '/authors/OL' || c_custkey AS key, c_name AS name, 'Q' || c_custkey AS wikidata FROM customer WHERE c_custkey % 3 = 0")
def q70_dump_prefilter(spark, table):
    """Records of a dump with an external id, other records and kinds left in the raw text."""
    path = _scratch(spark)
    ids = F.create_map(F.when(F.col("c_custkey") % 3 == 0, "wikidata").otherwise("viaf"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")))
    record = F.to_json(F.struct(F.col("c_name").alias("name"), ids.alias("remote_ids")))
    kind = F.when(F.col("c_custkey") >= 0, "/type/author")
    lines = table("customer").select(F.concat_ws("\t", kind, F.concat(F.lit("/authors/OL"), F.col("c_custkey").cast("string")), F.lit("1"), F.lit("2020"), record).alias("value"))
    lines.union(table("part").select(F.concat_ws("\t", F.lit("/type/work"), F.lit("/works/W"), F.lit("1"), F.lit("2020"), F.lit('{"remote_ids": {"wikidata": "no"}}')))).write.text(path)
    found = files.read_dump(spark, path, needs='"wikidata"')
    return found.select("key", "name", F.col("remote_ids")["wikidata"].alias("wikidata"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 4 = 1 THEN -o_custkey END::int AS n FROM orders")
def q71_tolerant_int(spark, table):
    """Whole numbers of cells, null where a cell is none."""
    cell = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' ', o_custkey, ' ') WHEN 1 THEN concat('-', o_custkey) WHEN 2 THEN concat(o_custkey, '?') END")
    return table("orders").select("o_orderkey", scalar.tolerant_int(cell).alias("n"))


@query("SELECT count(*) AS links, count(DISTINCT (l_partkey, l_suppkey)) AS offers FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def q72_composite_key_join(spark, table):
    """A reference joined on two columns at once: credits to offers of a part by a supplier."""
    offer = TripleMap("offer", "offers", EX + "offer/{o_part}/{o_supp}", (O + "Offer",), key=("o_part", "o_supp"))
    credit = TripleMap("credit2", "lineitem", CREDIT.subject, joins=(Join(O + "offer", "offer", (("l_partkey", "o_part"), ("l_suppkey", "o_supp"))),))
    offers = table("lineitem").select(F.col("l_partkey").alias("o_part"), F.col("l_suppkey").alias("o_supp")).distinct()
    data = MappedGraph([offer, credit], {"lineitem": table("lineitem"), "offers": offers})
    return ask(data, "SELECT (COUNT(?c) AS ?links) (COUNT(DISTINCT ?o) AS ?offers) WHERE { ?c o:offer ?o . ?o a o:Offer }")


@query(f"SELECT '{EX}order/' || o_orderkey AS work FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996")
def q73_year_facet(spark, table):
    state = facets.State(O + "Order", facets=(facets.Facet(O + "year", "year", low=1995, high=1996),))
    return facets.matches(graph(table, "purchase"), state, [T.LABEL])


@query(f"SELECT '{EX}part/' || p_partkey AS work FROM part WHERE contains(lower(p_name), 'bolt') AND p_size > 25")
def q74_text_facet(spark, table):
    state = facets.State(O + "Part", facets=(facets.Facet(T.LABEL, "text", value="BOLT"), facets.Facet(O + "big", "boolean", value="1")))
    return facets.matches(graph(table, "part"), state, [T.LABEL])


_TONGUE = "CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '' ELSE 'Land ' || n_nationkey END"
TONGUES = TripleMap("tongues", "nation", EX + "nation/{n_nationkey}", rules=(Rule(T.LABEL, column="n_name", lang="en"), Rule(T.LABEL, column="n_german", lang="de"), Rule(O + "near", iri=EX + "region/{n_regionkey}")), key=("n_nationkey",))


def _tongues(table) -> MappedGraph:
    return MappedGraph([TONGUES], {"nation": table("nation").withColumn("n_german", F.expr("CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '' ELSE concat('Land ', n_nationkey) END"))})


@query(f"SELECT '{EX}nation/' || n_nationkey AS n, coalesce(nullif({_TONGUE}, ''), n_name) AS shown FROM nation")
def q75_language_with_fallback(spark, table):
    """The label in one language, else that in another; empty and missing cells have none."""
    return ask(_tongues(table), 'SELECT ?n (COALESCE(?de, ?en) AS ?shown) WHERE { ?n rdfs:label ?en FILTER(LANG(?en) = "en") OPTIONAL { ?n rdfs:label ?de FILTER(LANG(?de) = "de") } }')


@query(f"SELECT p, count(*) AS n FROM (SELECT '{O}near' AS p FROM nation) GROUP BY p")
def q76_is_iri(spark, table):
    """Predicates whose objects are IRIs: a filter on the kind of a term."""
    return ask(_tongues(table), "SELECT ?p (COUNT(?o) AS ?n) WHERE { ?s ?p ?o FILTER(ISIRI(?o) && !(ISBLANK(?o))) } GROUP BY ?p")


@query("SELECT 'region/' || n_regionkey AS place, count(*) AS n FROM (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_regionkey")
def q77_transitive_inference(spark, table):
    """A transitive property closed within inference: customers within regions."""
    rule = spark.createDataFrame([(O + "partOf", T.TYPE, T.TRANSITIVE, "uri", "", "")], T.SCHEMA)
    data = mapping.apply(LIVES, {"customer": table("customer")}).unionByName(graph(table, "nation").where(F.col("p") == O + "partOf"))
    far = reason.infer(data, rule).where((F.col("p") == O + "partOf") & F.startswith("s", F.lit(EX + "customer/")) & F.startswith("o", F.lit(EX + "region/")))
    return far.groupBy(F.replace("o", F.lit(EX), F.lit("")).alias("place")).agg(F.count("*").alias("n"))


@query(f"SELECT class, count(*) AS n FROM (SELECT '{EX}part/' || p_partkey AS s, unnest(['{O}Known', '{O}Part', {_B}, '{O}Work']) AS class FROM part) GROUP BY class UNION ALL SELECT '{T.THING}', count(*) FROM part")
def q78_union_and_thing(spark, table):
    """Members of the classes of a union are members of the union, and everything is a thing."""
    schema = catalogue(table)
    named = schema.unionByName(plain(table("part").limit(1), F.lit(O + "Known"), T.OWL + "unionOf", F.lit("_:cell1"), "bnode"))
    data = plain(table("part"), F.concat(F.lit(EX + "part/"), F.col("p_partkey").cast("string")), T.TYPE, F.concat(F.lit(CLASS), T.encode(F.col("p_brand"))))
    found = reason.infer(data, named, include_thing=True)
    return found.where((F.col("p") == T.TYPE) & ~F.startswith("o", F.lit("_:"))).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_brand >= 'Brand#4' AND p_type <> 'PROMO' GROUP BY p_brand, p_type")
def q79_unresolved_roles(spark, table):
    """Roles that neither the exact nor the general look-up resolves, with their rows."""
    look = table("part").where("p_brand < 'Brand#4'").select("p_brand", F.lit("").alias("p_type"), F.lit("g").alias("r")).union(table("part").where("p_type = 'PROMO'").select("p_brand", "p_type", F.lit("x"))).distinct()
    return prepare.unresolved(prepare.resolve_roles(table("part"), look, "p_brand", "p_type", "r"), "p_brand", "p_type")


@query("SELECT coalesce('http://example.org/g/' || o_orderstatus, '') AS graph, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT o_orderkey AS s, o_orderstatus FROM orders) GROUP BY 1")
def q80_quads_by_graph(spark, table):
    """Quads written as text, a graph for each order status, and counted by the graph of their lines."""
    quads = plain(table("orders").select("*"), F.concat(F.lit(EX + "order/"), F.col("o_orderkey").cast("string")), O + "status", F.col("o_orderstatus"), "literal").withColumn("graph", F.concat(F.lit(EX + "g/"), F.col("o")))
    lines = files.format_nquads(quads).select("value", F.regexp_extract("value", r"<([^>]*)> \.$", 1).alias("graph"))
    back = parse_ntriples(lines.select("value")).select("s", F.concat(F.lit(EX + "g/"), F.col("o")).alias("graph"))
    subjects = back.groupBy("graph").agg(F.countDistinct("s").alias("subjects"))
    return lines.groupBy("graph").agg(F.count("*").alias("n")).join(subjects, "graph")


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || ' e ' || c_custkey AS name FROM customer")
def q81_normalise(spark, table):
    """Names in lower case, without marks and signs, in the JVM."""
    raw = F.concat(F.col("c_name"), F.lit(" É- "), F.col("c_custkey").cast("string"), F.lit(" ́!"))
    return table("customer").select("c_custkey", scalar.normalise(raw).alias("name"))


@query("SELECT p_partkey, 'OL' || p_partkey || 'A' AS key, p_partkey::varchar AS local FROM part")
def q82_keys_and_local_names(spark, table):
    """Keys without the prefix of their kind, and the last part of an IRI."""
    n = F.col("p_partkey").cast("string")
    key = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/authors/OL").otherwise("/works/OL"), n, F.lit("A"))
    iri = F.concat(F.when(F.col("p_partkey") % 2 == 0, O).otherwise(EX + "part/"), n)
    return table("part").select("p_partkey", scalar.strip_key(key).alias("key"), T.local_name(iri).alias("local"))


@query("SELECT p_name AS name, p_size::varchar AS size FROM part ORDER BY p_size DESC, p_name LIMIT 1")
def q83_first_of_order(spark, table):
    """The first solution of an order."""
    return ask(virtual(table, "part"), "SELECT DISTINCT ?name ?size WHERE { ?x rdfs:label ?name ; o:size ?size } ORDER BY DESC(?size) ?name LIMIT 1")
