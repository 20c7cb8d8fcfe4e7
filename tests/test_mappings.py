"""Mapping files: every form the reader takes, on small sources of this test."""

import pytest

from tessera.operators.mapping import apply_all
from tessera.sources.mappings import parse_mappings
from tessera.terms import TYPE

E = "http://e/"
TEXT = r"""
prefixes: {e: "http://e/", f: "http://f/", xsd: "http://www.w3.org/2001/XMLSchema#"}
mappings:
  Figure:
    sources: [['figures.csv~csv']]
    s: $(iri)
    po:
      - [a, e:Figure~iri]
  Work:
    sources: [['works.csv~csv']]
    s: http://e/work/$(id)
    condition:
      function: f:notEqual
      parameters: [[f:a, $(kind)], [f:b, "skip"]]
    po:
      - [e:title, $(title), en~lang]
      - [e:note, "no. $(id)"]
      - p: e:year
        o: $(year)
        datatype: xsd:gYear
        condition:
          function: f:notEqual
          parameters: [[f:a, $(year)], [f:b, "\\N"]]
      - p: e:tag
        o: {function: f:string_split, parameters: [[f:v, $(tags)], [f:sep, "|"]]}
      - p: e:place
        o:
          function: f:controls_if
          parameters:
            - parameter: f:bool_b
              value:
                function: f:isNull
                parameters:
                  - parameter: f:str
                    value: &found {function: f:lookup, parameters: [[f:str, $(place)], [f:inputFile, "places.csv"], [f:fromColumn, "0"], [f:toColumn, "1"]]}
            - [f:any_true, "http://e/place/$(place)"]
            - parameter: f:any_false
              value: *found
          type: iri
      - p: e:short
        o: $(place)
        condition:
          function: f:equal
          parameters:
            - parameter: f:a
              value: {function: f:string_substring, parameters: [[f:v, $(place)], [f:param_int_i_from, "0"], [f:param_int_i_opt_to, "2"]]}
            - [f:b, $(place)]
      - p: e:shows
        o:
          - mapping: Figure
            condition: {function: equal, parameters: [[str1, "$(id)_$(who)"], [str2, "$(work)_$(person)"]]}
"""


def test_every_form(spark):
    make = lambda cols, *rows: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    sources = {
        "figures.csv": make("iri work person", (E + "fig1", "1", "x_y"), (E + "fig2", "1_x", "y"), ("", "1", "x_y")),
        "works.csv": make("id kind title year tags place who", ("1", "a", "T", "1999", "p|q| ", "XX", "x_y"), ("2", None, "", r"\N", None, "long", None), ("3", "skip", "S", "2000", "r", "XX", "z")),
        "places.csv": make("code iri", ("XX", E + "unknown"), ("XX", E + "zzz")),
    }
    got = sorted(tuple(r) for r in apply_all(parse_mappings(TEXT), sources).collect())
    one, two = E + "work/1", E + "work/2"
    assert got == sorted([
        (E + "fig1", TYPE, E + "Figure", "uri", "", ""), (E + "fig2", TYPE, E + "Figure", "uri", "", ""),
        (one, E + "title", "T", "literal", "", "en"), (one, E + "note", "no. 1", "literal", "", ""), (two, E + "note", "no. 2", "literal", "", ""),
        (one, E + "year", "1999", "literal", "http://www.w3.org/2001/XMLSchema#gYear", ""),
        (one, E + "tag", "p", "literal", "", ""), (one, E + "tag", "q", "literal", "", ""),
        (one, E + "place", E + "unknown", "uri", "", ""), (two, E + "place", E + "place/long", "uri", "", ""),
        (one, E + "short", "XX", "literal", "", ""), (one, E + "shows", E + "fig1", "uri", "", ""),
    ])


def test_long_names_of_keys():
    long = TEXT.replace("    s: ", "    subjects: ").replace("    po:", "    predicateobjects:").replace("- p: ", "- predicate: ").replace("        o: ", "        object: ").replace("        o:\n", "        objects:\n")
    assert long.count("object") > 5 and parse_mappings(long) == parse_mappings(TEXT)


def test_what_is_not_read():
    with pytest.raises(ValueError, match="unknown function: f:sing"):
        parse_mappings(TEXT.replace("f:string_substring", "f:sing"))
    with pytest.raises(ValueError, match="differ in shape"):
        parse_mappings(TEXT.replace("$(work)_$(person)", "$(work)-$(person)"))
    assert parse_mappings("mappings: {}") == []
