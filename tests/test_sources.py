"""Services behind HTTP against a local server, optional and required files, metrics, facet helpers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.functions import scalar
from tessera.operators import facets, prepare
from tessera.sources import web

E = "http://e/"
SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
WORK = {"key": "/works/W1", "title": "A", "first_publish_year": 1999, "subject": list("abcdefg"), "language": ["eng", "fre", "ger", "spa"]}


class Service(BaseHTTPRequestHandler):
    failures = 0

    def log_message(self, *_):
        pass

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if "query" in asked:
            if "bad" in asked["query"]:
                return self.answer(400, "no parse")
            if asked["query"].startswith("ASK"):
                return self.answer(200, json.dumps({"head": {}, "boolean": True}))
            return self.answer(200, json.dumps({"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"type": "uri", "value": E}}, {"x": {"type": "literal", "value": "1"}, "y": {"type": "literal", "value": ""}}]}}))
        if asked["author"] == "A2":
            return self.answer(500, "down")
        self.answer(200, json.dumps({"docs": [WORK, {}] if asked["author"] == "A1" else []}))

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_search_works(spark, address):
    authors = spark.createDataFrame([("A1", "One"), ("A2", "Two"), ("A3", None)], "key string, name string")
    got = sorted(web.search_works(authors, address, waits=(0,)).collect(), key=lambda r: r.work_key)
    assert [tuple(r) for r in got] == [("A1", "One", "", "", "", "", ""), ("A1", "One", "W1", "A", "1999", "a; b; c; d; e", "eng; fre; ger")]
    assert web.search_works(authors.limit(0), address).count() == 0


def test_attempts_end_after_the_last_wait():
    slept, calls = [], []

    def fails(x):
        calls.append(x)
        raise OSError

    assert web.persistent(fails, 1, sleep=slept.append) is None
    assert slept == [2, 4, 8] and len(calls) == 4
    with pytest.raises(KeyError):  # a fault of the caller's is not tried again
        web.persistent({}.__getitem__, 1, sleep=slept.append)


def test_endpoint(spark, address):
    e = web.Endpoint(address)
    assert e.ask("ASK {}") is True
    assert sorted(map(tuple, e.select(spark, "SELECT").collect())) == [("1", ""), (E, None)]
    with pytest.raises(web.EndpointError, match="HTTP 400: no parse") as raised:
        e.run("bad")
    assert raised.value.query == "bad"
    with pytest.raises(web.EndpointError, match="Network error"):
        web.Endpoint("http://127.0.0.1:1/").run("ASK {}")


def test_files_and_metrics(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,kind\n W1,book:Novel\n"W2","http://o/Play"\n')
    assert prepare.missing_files(spark, str(tmp_path), ["a.csv", "b.csv"]) == ["b.csv"]
    with pytest.raises(FileNotFoundError, match="b.csv"):
        prepare.require_files(spark, str(tmp_path), ["a.csv", "b.csv"])
    look = lambda n: sorted(map(tuple, prepare.optional_lookup(spark, f"{tmp_path}/{n}", "key", "kind", "book:", "http://b/").collect()))
    assert look("a.csv") == [("W1", "http://b/Novel"), ("W2", "http://o/Play")] and look("b.csv") == []
    prepare.write_metrics(spark, f"{tmp_path}/m", {"n": 3, "rows": spark.range(5).agg(F.count("*").alias("k"))})
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/m").collect()] == [{"n": 3, "rows": {"k": 5}}]


def test_rows_kept_and_keys(spark):
    df = spark.createDataFrame([("/works/W1", " YES ", "high"), ("/authors/A", "no", "high"), (None, None, None), ("W1", "yes", "low")], "id string, keep string, confidence string")
    assert [r.id for r in prepare.kept(df).collect()] == ["/works/W1", "W1"]
    assert [r.id for r in prepare.curated(df, "id", ["W1", "/works/W1"]).collect()] == ["/works/W1"]
    assert [r.k for r in df.select(scalar.strip_key(F.col("id")).alias("k")).collect()] == ["W1", "A", None, "W1"]


def test_facet_values(spark):
    names = ["zebra", "Éclair", "eclipse", "apple", "Zoo"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    assert [r.label for r in facets.by_name(df).collect()] == ["apple", "Éclair", "eclipse", "zebra", "Zoo"]
    assert facets.search_values(df, "Z").count() == 5
    assert sorted(r.label for r in facets.search_values(df, "Z", most=4).collect()) == ["Zoo", "zebra"]


def test_a_failing_facet_leaves_the_others(spark):
    rows = [(E + "w", T.TYPE, E + "C"), (E + "w", E + "p", E + "a"), (E + "w", E + "bad", "x")]
    data = spark.createDataFrame([(*r, "uri", "", "") for r in rows], SCHEMA)
    broken = data.withColumn("o", F.when(F.col("p") == E + "bad", F.raise_error(F.lit("broken"))).otherwise(F.col("o")))
    got = facets.counts_each(broken, facets.State(E + "C"), [E + "p", E + "bad"], [T.LABEL])
    assert [tuple(r) for r in got[E + "p"].collect()] == [(E + "p", E + "a", 1)]
    assert got[E + "bad"].collect() == []


class Graph(BaseHTTPRequestHandler):
    """An endpoint over four labels: answers VALUES ?n for one pattern, and remembers what it was asked."""

    asked: list = []
    names = {E + "n1": "One", E + "n2": "Two", E + "n3": 'Thr"ee', E + "n9": "Nine"}

    def log_message(self, *_):
        pass

    def do_GET(self):
        import re

        query = parse_qs(urlparse(self.path).query)["query"][0]
        Graph.asked.append(query)
        if "broken" in query:
            self.send_response(500)
            self.end_headers()
            return
        keys = re.findall(r"\(<([^>]*)>\)", query) or list(self.names)
        rows = [{"n": {"type": "uri", "value": k}, "label": {"type": "literal", "value": self.names[k], "xml:lang": "en"}} for k in keys if k in self.names]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"head": {"vars": ["n", "label"]}, "results": {"bindings": rows}}).encode())


def test_service_on_an_endpoint_is_a_bind_join(spark, monkeypatch):
    from tessera.plans import sparql
    from tessera.plans.algebra import Engine

    server = HTTPServer(("127.0.0.1", 0), Graph)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        end = web.Endpoint(f"http://127.0.0.1:{server.server_port}/")
        data = spark.createDataFrame([(f"{E}p{k}", E + "from", f"{E}n{k % 4}", "uri", "", "") for k in range(40)], SCHEMA)
        engine = Engine({"": data, E + "names": end})
        out = sparql.query(engine, f"SELECT ?p ?label WHERE {{ ?p <{E}from> ?n . SERVICE <{E}names> {{ ?n <{T.LABEL}> ?label }} }}")
        want = sorted((f"{E}p{k}", Graph.names[f"{E}n{k % 4}"]) for k in range(40) if k % 4)
        assert sorted(map(tuple, out.collect())) == want
        assert Graph.asked and all("VALUES (?n)" in q and E + "n9" not in q for q in Graph.asked)
        lone = sparql.query(engine, f"SELECT ?p ?label WHERE {{ ?p <{E}from> ?n OPTIONAL {{ SERVICE <{E}names> {{ ?n <{T.LABEL}> ?label }} }} }}")
        assert sorted((r.p, r.label or "") for r in lone.collect()) == sorted([*want, *((f"{E}p{k}", "") for k in range(0, 40, 4))])
        alone = sparql.query(engine, f"SELECT ?label WHERE {{ SERVICE <{E}names> {{ ?n <{T.LABEL}> ?label }} }}")
        assert sorted(r.label for r in alone.collect()) == sorted(Graph.names.values())
        keys = spark.createDataFrame([((E + "broken", "uri", "", ""),), ((E + "n1", "uri", "", ""),)], "n struct<value:string,kind:string,dt:string,lang:string>")
        rows = end.answers(keys.repartition(1), "?n ?p ?label .", ["n", "label"], batch=1, waits=()).collect()
        assert sorted((r.label and r.label.value, bool(r.error)) for r in rows if r.error is None) == [("One", False)] and sum(bool(r.error) for r in rows) == 1
        monkeypatch.setattr(web, "WAITS", ())
        broken = spark.createDataFrame([(E + "p", E + "from", E + "broken", "uri", "", "")], SCHEMA)
        with pytest.raises(ValueError, match="SERVICE"):
            sparql.query(Engine({"": broken, E + "names": web.Endpoint(end.url, 5)}), f"SELECT ?p WHERE {{ ?p <{E}from> ?n . SERVICE <{E}names> {{ ?n <{T.LABEL}> ?label }} }}").collect()
    finally:
        server.shutdown()


def test_failed_keys_are_counted(spark, address):
    from pyspark.sql import Observation

    seen = Observation()
    authors = spark.createDataFrame([("A1", "One"), ("A2", "Two"), ("A3", None)], "key string, name string")
    assert web.search_works(authors, address, waits=(0,), counters=seen).count() == 2
    assert seen.get == {"works": 2, "failed": 1}


def test_normalise_equals_unicode_data_without_python(spark):
    import random
    import re
    import unicodedata

    def fold(t):
        plain = "".join(x for x in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(x))
        return re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", plain)).strip()

    r = random.Random(1)
    odd = [chr(k) for k in range(0x250)] + list("ﬁﬀ½①Ａｚ𝐀𝟘ﷺİıßæøŁΣς́̈𐀀日本Ⅷ㎏™é가ǅ")
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 12))) for _ in range(600)] + odd + [None, "", "  Émile  O'Brien-Žák "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalar.normalise(F.col("t")).alias("n"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {x.k: x.n for x in df.collect()}
    assert [t for k, t in enumerate(texts) if got[k] != fold(t)] == []
