"""RDF terms as columns: IRIs, literals, blank nodes, and the triple layout.

A triple is (s, p, o, o_kind, o_dt, o_lang): o_kind is uri, literal or bnode; o_dt a datatype IRI or
''; o_lang a language tag or ''. Empty strings, not nulls, mean "none", so filters need no null
logic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLE = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, SUB_CLASS, SUB_PROPERTY = RDF + "type", RDFS + "label", RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE, INVERSE, SAME_AS = RDFS + "domain", RDFS + "range", OWL + "inverseOf", OWL + "sameAs"
THING, NAMED_INDIVIDUAL, TRANSITIVE, DISJOINT = OWL + "Thing", OWL + "NamedIndividual", OWL + "TransitiveProperty", OWL + "disjointWith"

NULL_MARK = r"\N"


def is_null(c: Column) -> Column:
    """Both spellings of a missing cell: the marker and the empty string (and a real null)."""
    return c.isNull() | c.isin("", NULL_MARK)


def clean(c: Column) -> Column:
    """Missing cells as ''."""
    return F.when(is_null(c), F.lit("")).otherwise(c)


def encode(c: Column) -> Column:
    """Percent-encode everything but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def template(text: str) -> Column:
    """A template such as 'http://x/{a}/{b}' with encoded column values."""
    parts, rest = [], text
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), encode(F.col(name).cast("string"))]
    return F.concat(*parts, F.lit(rest))


def local_name(c: Column) -> Column:
    """What follows the last '#', else the last '/'."""
    return F.when(F.instr(c, "#") > 0, F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def year_number(c: Column) -> Column:
    """The first signed number in a lexical form, as a long."""
    return F.regexp_extract(c, "-?[0-9]+", 0).try_cast("bigint")


def boolean(c: Column) -> Column:
    """xsd:boolean by value: 1/true, 0/false, else null."""
    return F.when(c.isin("1", "true"), F.lit(True)).when(c.isin("0", "false"), F.lit(False))
