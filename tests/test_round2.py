"""Facet addresses, filters, inference to a fixpoint and its axioms, by small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.functions import scalar
from tessera.operators import facets, reason
from tessera.plans import sparql
from tessera.plans.algebra import Engine

E = "http://e/"
SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
NUMBERS = st.one_of(st.integers(-10**9, 10**9).map(float), st.floats(-1e6, 1e6).map(lambda x: x + 0.0))


def triples(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "uri", r[4] if len(r) > 4 else "", "") for r in rows], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([E + "route_to", E + "year", E + "a_from", E + "x_from_to"]), st.sampled_from(["year", "integer"]), st.none() | NUMBERS, st.none() | NUMBERS)
def test_state_round_trip(prop, kind, low, high):
    if low is None and high is None:
        return
    state = facets.State(E + "C", facets=(facets.Facet(prop, kind, low=low, high=high),))
    assert facets.State.from_params(state.to_params()) == state


def test_parse_year_patterns(spark):
    rows = ["about 1802", "14 cent. 1350", "19th century", "ca. 1900", "\t1850\n"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw string")
    year, outcome = scalar.parse_year(F.col("raw"))
    got = [(r.y, r.o) for r in df.select("k", year.alias("y"), outcome.alias("o")).orderBy("k").collect()]
    assert got == [(1802, "extracted"), (1350, "extracted"), (None, "century"), (1900, "uncertain"), (1850, "clean")]


def ask(spark, data, text):
    return sorted(tuple(r) for r in sparql.query(Engine({"": data}), text).collect())


def test_filters(spark):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    data = triples(spark, [(E + "a", E + "n", "1", "literal", xsd + "integer"), (E + "b", E + "n", "1.0", "literal", xsd + "decimal"), (E + "c", E + "n", "5", "literal", xsd + "integer"), (E + "a", E + "t", "apple", "literal"), (E + "c", E + "t", "pear", "literal"), (E + "c", E + "seen", E + "x")])
    def q(f):
        return [r[0] for r in ask(spark, data, f"SELECT ?s WHERE {{ ?s <{E}n> ?o . {f} }}")]

    assert q(f"FILTER(?o > 0 && NOT EXISTS {{ ?s <{E}seen> ?x }})") == [E + "a", E + "b"]
    assert q(f"FILTER(?o > 3 || EXISTS {{ ?s <{E}t> ?x }})") == [E + "a", E + "c"]
    assert q(f"?s <{E}t> ?t . FILTER(REGEX(?t, \"^APP\", \"i\"))") == [E + "a"]
    assert q(f"?s <{E}t> ?t . FILTER(?t < \"b\")") == [E + "a"]
    assert sorted(ask(spark, data, f"SELECT ?s ?z WHERE {{ ?s <{E}n> ?o . ?z <{E}n> ?w . FILTER(?o = ?w && ?s != ?z) }}")) == [(E + "a", E + "b"), (E + "b", E + "a")]
    with pytest.raises(ValueError, match="SHA1"):
        q("FILTER(SHA1(?o) = \"x\")")


def test_inference_reaches_a_fixpoint(spark):
    o = T.OWL
    schema = triples(spark, [
        (E + "p", T.INVERSE, E + "q"), (E + "q", T.SUB_PROPERTY, E + "r"), (E + "r", T.DOMAIN, E + "D"), (E + "D", T.SUB_CLASS, E + "Top"),
        (E + "r", T.TYPE, T.TRANSITIVE), (E + "U", o + "unionOf", "_:l", "bnode"), ("_:l", T.RDF + "first", E + "D"), ("_:l", T.RDF + "rest", "_:m", "bnode"), ("_:m", T.RDF + "first", E + "X"), ("_:m", T.RDF + "rest", T.RDF + "nil"),
    ])
    out = {(r.s, r.p, r.o) for r in reason.infer(triples(spark, [(E + "x", E + "p", E + "y"), (E + "z", E + "p", E + "x")]), schema).collect()}
    assert {(E + "y", E + "q", E + "x"), (E + "y", E + "r", E + "x"), (E + "y", E + "r", E + "z")} <= out
    assert {(E + "y", T.TYPE, E + c) for c in ("D", "Top", "U")} <= out and (E + "x", T.TYPE, E + "U") in out


def test_lists_of_disjoint_classes_and_different_individuals(spark):
    o = T.OWL
    schema = triples(spark, [
        ("_:d", T.TYPE, o + "AllDisjointClasses"), ("_:d", o + "members", "_:1", "bnode"), ("_:1", T.RDF + "first", E + "A"), ("_:1", T.RDF + "rest", "_:2", "bnode"), ("_:2", T.RDF + "first", E + "B"), ("_:2", T.RDF + "rest", T.RDF + "nil"),
        ("_:f", T.TYPE, o + "AllDifferent"), ("_:f", o + "distinctMembers", "_:3", "bnode"), ("_:3", T.RDF + "first", E + "i"), ("_:3", T.RDF + "rest", "_:4", "bnode"), ("_:4", T.RDF + "first", E + "j"), ("_:4", T.RDF + "rest", T.RDF + "nil"),
    ])
    data = triples(spark, [(E + "x", T.TYPE, E + "A"), (E + "x", T.TYPE, E + "B"), (E + "y", T.TYPE, E + "A"), (E + "j", T.SAME_AS, E + "i")])
    got = {tuple(r) for r in reason.violations(data, schema).collect()}
    assert got == {("disjoint", E + "x", f"{E}A {E}B"), ("different", E + "i", E + "j")}
