"""Sources and sinks: CSV, tab-separated JSON dumps, N-Triples, Turtle, and named datasets."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import sizes
from tessera.terms import RDF, SCHEMA, TRIPLE, XSD


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A relation of strings with a header row; empty cells are '' (a meaningful key), not null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


AUTHOR_JSON = "name string, personal_name string, birth_date string, death_date string, remote_ids map<string,string>, alternate_names array<string>"


def read_dump(spark: SparkSession, path: str, kind: str = "/type/author", schema: str = AUTHOR_JSON, needs: str = "", counters: Observation | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
    """Records of one kind from a dump of lines type, key, revision, modified, JSON.

    Short lines and malformed JSON are skipped. gzip can't be split, so rows are dealt out anew.

    needs: a text that a record's JSON has to contain, such as a key of an external id; it is looked for
    in the raw text, so other records are neither moved nor parsed. counters: filled, when the records
    are used, with what the whole dump holds: lines, records (of the kind), needed (of these, with the
    text), and measures: aggregates over raw, the JSON of every record of the kind (else null). The dump
    is read once for all of them.
    """
    part = F.split("value", "\t", 5)
    lines = spark.read.text(path).select(part.alias("f"))
    is_record = (F.size("f") == 5) & (F.get("f", F.lit(0)) == kind)
    lines = lines.select(F.get("f", F.lit(1)).alias("key"), F.when(is_record, F.get("f", F.lit(4))).alias("raw"))
    wanted = F.coalesce(F.contains("raw", F.lit(needs)), F.lit(False))
    if counters is not None:
        lines = lines.observe(counters, F.count(F.lit(1)).alias("lines"), F.count("raw").alias("records"), F.count_if(wanted).alias("needed"), *(c.alias(n) for n, c in (measures or {}).items()))
    rows = lines.where(wanted).repartition(spark.sparkContext.defaultParallelism).select("key", F.from_json("raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return rows.where("j IS NOT NULL AND j._bad IS NULL").select("key", "j.*").drop("_bad")


def _unescape(c):
    """N-Triples escapes; \\uXXXX forms are decoded by the JSON reader."""
    return F.when(F.instr(c, "\\") > 0, F.coalesce(F.from_json(F.concat(F.lit('["'), F.regexp_replace(c, r"\\'", "'"), F.lit('"]')), "array<string>")[0], c)).otherwise(c)


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines (a trailing graph term of N-Quads is ignored); others are skipped."""
    subject, predicate = r"^\s*(?:<([^>]*)>|(_:\S+))", r"\s*<([^>]*)>"
    rest = r"\s*(?:<([^>]*)>|(_:\S+)|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<[^>]*>\s*)?\.\s*$"
    pattern = subject + predicate + rest
    g = [F.regexp_extract(column, pattern, k) for k in range(9)]
    rows = lines.where(F.col(column).rlike(pattern))
    return rows.select(
        F.when(g[1] != "", g[1]).otherwise(g[2]).alias("s"), g[3].alias("p"),
        F.when(g[4] != "", g[4]).when(g[5] != "", g[5]).otherwise(_unescape(g[6])).alias("o"),
        F.when(g[4] != "", "uri").when(g[5] != "", "bnode").otherwise("literal").alias("o_kind"), g[7].alias("o_dt"), g[8].alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path)).distinct()


def _statement() -> Column:
    """Subject, predicate and object of a triple as N-Triples writes them."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(""))
    return F.concat_ws(" ", node(F.col("s")), node(F.col("p")), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"))))


def format_ntriples(triples: DataFrame) -> DataFrame:
    """One column, value: N-Triples lines."""
    return triples.select(F.concat_ws(" ", _statement(), F.lit(".")).alias("value"))


def format_nquads(quads: DataFrame, graph: str = "graph") -> DataFrame:
    """N-Quads lines of triples with a column of graph IRIs; a null or empty one is the default graph."""
    name = F.when(F.coalesce(F.col(graph), F.lit("")) != "", F.concat(F.lit("<"), F.col(graph), F.lit(">")))
    return quads.select(F.concat_ws(" ", _statement(), name, F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str, graph: str = "graph") -> None:
    """Distinct lines as text."""
    format_nquads(quads, graph).distinct().write.mode("overwrite").text(path)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Sorted out duplicates, then text; N-Quads of the default graph look the same."""
    format_ntriples(triples.select(*TRIPLE).distinct()).write.mode("overwrite").text(path)


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>\"{3}(?:[^\\]|\\.)*?\"{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<dt>\^\^)
    |(?P<num>[+-]?(?:[0-9]+\.[0-9]+|[0-9]+)(?![A-Za-z]))|(?P<bn>_:[A-Za-z0-9_.-]*[A-Za-z0-9_-])|(?P<pn>[A-Za-z][\w.-]*:[\w%.-]*[\w%-]|[A-Za-z][\w.-]*:|:[\w%-]*|a(?=\s)|true|false)|(?P<punct>[;,.\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def parse_turtle(text: str, scope: str = "f") -> list[tuple]:
    """Triples of a Turtle document; an ontology-sized file, so it is parsed on the driver.

    Blank nodes are named by scope and order of appearance, so loading twice gives equal names.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle: unexpected {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
    prefixes, out, pos, fresh = {}, [], 0, 0

    def peek():
        return tokens[pos] if pos < len(tokens) else ("end", "")

    def take(value=None):
        nonlocal pos
        got = peek()
        if value is not None and got[1] != value:
            raise ValueError(f"Turtle: expected {value}, found {got[1]!r}")
        pos += 1
        return got

    def bnode():
        nonlocal fresh
        fresh += 1
        return (f"_:{scope}{fresh}", "bnode", "", "")

    def term():
        kind, v = take()
        if kind == "iri":
            return (v[1:-1], "uri", "", "")
        if v == "a":
            return (RDF + "type", "uri", "", "")
        if v in ("true", "false"):
            return (v, "literal", XSD + "boolean", "")
        if kind == "pn":
            p, n = v.split(":", 1)
            return (prefixes[p] + n, "uri", "", "")
        if kind == "bn":
            return (f"_:{scope}_{v[2:]}", "bnode", "", "")
        if kind == "num":
            return (v, "literal", XSD + ("decimal" if "." in v else "integer"), "")
        if kind in ("str", "long"):
            cut = 3 if kind == "long" else 1
            value = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1]), v[cut:-cut])
            if peek()[0] == "lang":
                return (value, "literal", "", take()[1][1:])
            if peek()[0] == "dt":
                take()
                return (value, "literal", term()[0], "")
            return (value, "literal", "", "")
        if v == "[":
            node = bnode()
            if peek()[1] != "]":
                pairs(node)
            take("]")
            return node
        if v == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            head = (RDF + "nil", "uri", "", "")
            for item in reversed(items):
                node = bnode()
                out.append((node[0], RDF + "first", *item))
                out.append((node[0], RDF + "rest", *head))
                head = node
            return head
        raise ValueError(f"Turtle: unexpected {v!r}")

    def pairs(subject):
        while True:
            p = term()[0]
            while True:
                out.append((subject[0], p, *term()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]", ""):
                return

    while pos < len(tokens):
        kind, v = peek()
        if v.lower() in ("@prefix", "@base"):
            take()
            name = take()[1][:-1] if v.lower() == "@prefix" else None
            prefixes[name] = take()[1][1:-1]
            take(".")
            continue
        pairs(term())
        take(".")
    return list(dict.fromkeys(out))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A Turtle file as triples."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_turtle(text, "t" + re.sub(r"\W", "", path.rsplit("/", 1)[-1])), SCHEMA)


class Catalog:
    """Named datasets of triples: load (append as a set), replace, drop, count.

    A dataset may be kept closed under a schema: what is loaded then is inferred from at once, and the
    rest is left alone. Each change gives a dataset a new version.
    """

    def __init__(self):
        self._sets: dict[str, DataFrame] = {}
        self._closed: dict = {}
        self._versions: dict[str, int] = {}

    def version(self, name: str) -> int:
        return self._versions.get(name, 0)

    def _changed(self, name: str) -> None:
        self._versions[name] = self.version(name) + 1

    def close(self, name: str, schema: DataFrame) -> None:
        """Close a dataset under a schema, and keep it so as more is loaded."""
        from tessera.operators import reason

        closed = reason.close(self._sets[name], schema)
        self._closed[name] = schema, replace(closed, triples=reason.cut(closed.triples))
        self._changed(name)

    def closed(self, name: str):
        """The closed form of a dataset (canonical facts, components)."""
        return self._closed[name][1]

    def load(self, name: str, triples: DataFrame, mode: str = "append") -> DataFrame:
        from tessera.operators import reason

        new = triples.select(*TRIPLE)
        if name in self._closed:
            schema, old = self._closed[name]
            closed = reason.extend(old, new, schema) if mode == "append" else reason.close(new, schema)
            self._closed[name] = schema, replace(closed, triples=reason.cut(closed.triples))
        self._changed(name)
        if mode == "append" and name in self._sets:
            new = self._sets[name].unionByName(new)
        self._sets[name] = sizes.distinct(new, "s", "o")
        return self._sets[name]

    def drop_all(self, name: str) -> None:
        self._sets[name] = self._sets[name].limit(0)
        self._closed.pop(name, None)
        self._changed(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self._sets[name]

    def count(self, name: str) -> int:
        return self._sets[name].count()

    def save(self, name: str, path: str) -> None:
        """Parquet partitioned by predicate, so that a constant predicate reads its own files only."""
        self._sets[name].withColumn("predicate", F.col("p")).write.mode("overwrite").partitionBy("predicate").parquet(path)

    def open(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        self._sets[name] = spark.read.parquet(path).select(*TRIPLE)
        self._closed.pop(name, None)
        self._changed(name)
        return self._sets[name]
