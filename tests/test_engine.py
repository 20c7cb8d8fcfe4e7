"""Operators on small fixtures: sources, mappings, entity rules, paths, state."""

import pytest
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.functions import scalar
from tessera.operators import facets, federation, mapping, prepare, reason
from tessera.operators.mapping import Join, Rule, TripleMap
from tessera.plans import sparql
from tessera.plans.algebra import Engine, compatible_join
from tessera.sources import files

TTL = """@prefix ex: <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# a comment
ex:A rdfs:subClassOf ex:B , ex:C ; rdfs:label "a \\"x\\""@en , 'b' .
ex:p rdfs:domain [ a owl:Class ; owl:unionOf ( ex:A ex:B ) ] ; ex:n 5, 2.5 ; ex:t true .
"""


def test_turtle(spark):
    got = files.parse_turtle(TTL)
    assert ("http://e/A", T.LABEL, 'a "x"', "literal", "", "en") in got
    assert ("http://e/p", "http://e/n", "2.5", "literal", T.XSD + "decimal", "") in got
    data = spark.createDataFrame(got, T.SCHEMA)
    assert {r.member for r in reason.list_members(data).collect()} == {"http://e/A", "http://e/B"}
    assert files.parse_turtle(TTL) == got  # blank nodes are named the same again
    with pytest.raises(ValueError):
        files.parse_turtle("ex:a ~ .")


def test_ntriples_round_trip(spark):
    rows = [("http://e/a", "http://e/p", 'x "q" \\ \n\té', "literal", "", "fr"), ("_:b", "http://e/p", "http://e/o", "uri", "", ""), ("http://e/a", "http://e/p", "5", "literal", T.XSD + "integer", ""), ("http://e/a", "http://e/p", "_:b", "bnode", "", "")]
    df = spark.createDataFrame(rows, T.SCHEMA)
    assert sorted(map(tuple, files.parse_ntriples(files.format_ntriples(df)).collect())) == sorted(rows)
    assert files.parse_ntriples(spark.createDataFrame([("# no",), ("<a> <b> <c> <g> .",)], "value string")).count() == 1


def test_csv_keeps_empty_cells_and_markers(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'a,b\r\n1,\r\n"x, ""y""",\\N\r\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [("1", ""), ('x, "y"', "\\N")]
    assert [tuple(r) for r in prepare.clean_nulls(df).collect()] == [("1", ""), ('x, "y"', "")]


def test_dump(spark, tmp_path):
    good = '/type/author\t/authors/A\t1\t2\t{"name": "N\\tx", "remote_ids": null, "alternate_names": ["b"]}'
    (tmp_path / "d.txt").write_text("\n".join([good, "/type/work\tk\t1\t2\t{}", "short\tline", "/type/author\tk\t1\t2\t{bad"]))
    assert [(r.key, r.name, r.alternate_names) for r in files.read_dump(spark, str(tmp_path / "d.txt")).collect()] == [("/authors/A", "N\tx", ["b"])]


def test_composite_join_and_lists(spark):
    left = spark.createDataFrame([("1", "a", "x, y,"), ("2", "b", "\\N")], "k1 string, k2 string, names string")
    right = spark.createDataFrame([("1", "a"), ("1", "b")], "k1 string, k2 string")
    parent = TripleMap("r", "right", "http://e/r/{k1}/{k2}")
    child = TripleMap("l", "left", "http://e/l/{k1}", rules=(Rule("p", column="names", split=","),), joins=(Join("j", "r", (("k1", "k1"), ("k2", "k2"))),))
    got = {(r.s, r.p, r.o) for r in mapping.apply(child, {"left": left, "right": right}, {"r": parent}).collect()}
    assert got == {("http://e/l/1", "p", "x"), ("http://e/l/1", "p", "y"), ("http://e/l/1", "j", "http://e/r/1/a")}


def test_encode(spark):
    assert spark.range(1).select(T.encode(F.lit("a b~*é/+"))).first()[0] == "a%20b~%2A%C3%A9%2F%2B"


@pytest.mark.parametrize("raw,year,outcome", [("", None, "absent"), ("fl. 1500", None, "floruit"), ("19th century", None, "century"), ("active 1900s", None, "decade"), ("unknown", None, "unparseable"), ("1802", 1802, "clean"), ("ca. 1802", 1802, "uncertain"), ("1802?", 1802, "uncertain"), ("26 February 1802", 1802, "extracted"), ("2150", 2150, "clean")])
def test_parse_year(spark, raw, year, outcome):
    y, o = scalar.parse_year(F.lit(raw))
    assert tuple(spark.range(1).select(y, o).first()) == (year, outcome)


def test_names(spark):
    assert spark.range(1).select(scalar.normalise(F.lit("  Émile  O'Brien-Žák "))).first()[0] == "emile o brien zak"
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    got = spark.range(1).select(scalar.names_match(a("x", "y"), a("y", "x", "z")), scalar.names_match(a("x"), a("y")), scalar.names_match(a(), a("y"))).first()
    assert tuple(got) == (True, False, False)
    d = lambda *v: scalar.life_dates_match(*(F.lit(x).cast("int") for x in v))
    assert tuple(spark.range(1).select(d(1800, 1803, None, 5), d(1800, 1900, 1, 1), d(None, 1, 1, None)).first()) == (True, False, None)


def test_unbound_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([("x", "p"), ("y", "q")], "v string, w string")
    got = {tuple(r) for r in compatible_join(a, b, maybe=frozenset({"v"})).select("k", "v", "w").collect()}
    assert got == {(1, "x", "p"), (2, "x", "p"), (2, "y", "q")}


def test_undeclared_prefix(spark):
    with pytest.raises(ValueError):
        sparql.Parser("SELECT ?x WHERE { ?x zz:p ?y }").query()


def test_sparql_or_not_exists_and_union(spark):
    rows = [("a", "p", "1", "literal", "", ""), ("b", "p", "2", "literal", "", ""), ("c", "p", "_:n", "bnode", "", ""), ("c", "q", "z", "uri", "", "")]
    e = Engine({"": spark.createDataFrame(rows, T.SCHEMA)})
    text = "PREFIX x: <> SELECT ?s WHERE { ?s <p> ?o FILTER(!isBlank(?o) || NOT EXISTS { ?s <q> ?z }) }"
    assert sorted(r.s for r in sparql.query(e, text).collect()) == ["a", "b"]
    assert sparql.query(e, "SELECT ?s ?k WHERE { { ?s <p> ?o } UNION { ?s <q> ?k } } ORDER BY ?s LIMIT 2 OFFSET 2").count() == 2


def test_cyclic_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    assert {tuple(r) for r in reason.closure(e).collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("a", "a", 2), ("b", "b", 2), ("a", "c", 2)}


def test_state_round_trip():
    s = facets.State("http://r", page=3, q="x y", facets=(facets.Facet("http://e/b", "enum", ("u", "v")), facets.Facet("http://e/y", "year", low=1900, high=2000), facets.Facet("http://e/f", "boolean", value="true")))
    assert facets.State.from_params(s.to_params()) == s
    assert s.with_query("z").page == 1 and s.with_root("q").facets == ()
    assert s.fingerprint() == facets.replace(s, page=9).fingerprint()


def test_strategies(spark):
    left, right = spark.range(5).withColumnRenamed("id", "k"), spark.range(3, 300).withColumnRenamed("id", "k")
    got = federation.run({"oracle": lambda: left.join(right, "k"), "bind": lambda: federation.bind_join(left, right, "k"), "broken": lambda: left.select("nope")}, "oracle")
    assert [m.equal for m in got] == [True, True, None] and got[2].error and "bind" in federation.report(got)


def test_log_lines(spark):
    lines = ["12:00 INFO Fuseki :: [1] POST http://h/x", "12:00 INFO Fuseki :: [2] GET http://h/y", "12:00 INFO Fuseki :: [2] 200 OK"]
    assert {(r.method, r.n) for r in prepare.count_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()} == {("POST", 1), ("GET", 1)}
