"""Sources behind HTTP: a search service asked per key, and SPARQL endpoints.

Calls are made on the executors, one key after another in a task, and are tried again after growing
waits. A key whose calls all fail gives no rows, as does a service that finds nothing.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Seconds before the second, third and fourth attempt (fixed values).
WAITS = (2, 4, 8)

FOUND = "key string, name string, work_key string, title string, first_publish_year string, subjects string, languages string"


def get_json(url: str, headers: dict[str, str] | None = None, timeout: float = 60) -> dict:
    """The JSON that a GET of the address gives."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
        return json.load(r)


def persistent(call: Callable, *args, waits=WAITS, sleep: Callable = time.sleep):
    """call(*args), tried once and again after each wait; None if all attempts fail."""
    for wait in (*waits, None):
        try:
            return call(*args)
        except (OSError, ValueError, http.client.HTTPException):  # network and HTTP errors; bodies that are not JSON
            if wait is not None:
                sleep(wait)
    return None


def search_url(base: str, key: str, limit: int) -> str:
    """The address of one author's works, most editions first."""
    fields = {"author": key, "fields": "key,title,first_publish_year,subject,language", "limit": limit, "sort": "editions"}
    return f"{base}?{urllib.parse.urlencode(fields)}"


def search_works(authors: DataFrame, base: str, limit: int = 10, fetch: Callable[[str], dict] = get_json, waits=WAITS, subjects: int = 5, languages: int = 3, counters: Observation | None = None) -> DataFrame:
    """Works of the authors (key, name) from a search service, a row each (columns of FOUND).

    The first few subjects and languages are joined by "; "; missing fields are empty. counters: filled
    with works found and keys failed (all attempts of which failed), when the works are used.
    """

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, name in zip(frame["key"], frame["name"]):
                answer = persistent(lambda k=key: fetch(search_url(base, k, limit)), waits=waits)
                if answer is None:
                    rows.append((key, name, None))
                    continue
                rows += [(key, name, json.dumps(doc)) for doc in answer.get("docs") or []]
            yield pd.DataFrame(rows, columns=["key", "name", "doc"], dtype=object)

    doc = "key string, title string, first_publish_year string, subject array<string>, language array<string>"
    raw = authors.select("key", "name").mapInPandas(over, "key string, name string, doc string")
    if counters is not None:
        raw = raw.observe(counters, F.count("doc").alias("works"), F.count_if(F.col("doc").isNull()).alias("failed"))
    raw = raw.where("doc IS NOT NULL").withColumn("d", F.from_json("doc", doc))
    few = lambda c, n: F.coalesce(F.array_join(F.slice(c, 1, n), "; "), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select("key", "name", F.replace(text("d.key"), F.lit("/works/"), F.lit("")).alias("work_key"), text("d.title").alias("title"), text("d.first_publish_year").alias("first_publish_year"), few("d.subject", subjects).alias("subjects"), few("d.language", languages).alias("languages"))


class EndpointError(Exception):
    """A failed query, with its text."""

    def __init__(self, message: str, query: str):
        super().__init__(message)
        self.query = query


def _term(b: dict | None) -> dict | None:
    """A term struct of one binding of the standard JSON results."""
    if b is None:
        return None
    kind = {"typed-literal": "literal"}.get(b["type"], b["type"])
    value = f"_:{b['value'].removeprefix('_:')}" if kind == "bnode" else b["value"]
    return {"value": value, "kind": kind, "dt": b.get("datatype", ""), "lang": b.get("xml:lang", "")}


class Endpoint:
    """A SPARQL endpoint asked by GET; answers are the standard JSON results."""

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout = url, timeout

    def run(self, query: str) -> dict:
        address = f"{self.url}?{urllib.parse.urlencode({'query': query})}"
        try:
            return get_json(address, {"Accept": "application/sparql-results+json"}, self.timeout)
        except urllib.error.HTTPError as e:
            raise EndpointError(f"HTTP {e.code}: {e.read().decode(errors='replace') or e.reason}", query) from e
        except (OSError, ValueError, http.client.HTTPException) as e:
            raise EndpointError(f"Network error: {e}", query) from e

    def ask(self, query: str) -> bool:
        return bool(self.run(query).get("boolean"))

    def answers(self, keys: DataFrame, group: str, names: list[str], batch: int = 50, waits=WAITS) -> DataFrame:
        """Solutions of a group of patterns for given keys: columns of names as terms, and error.

        keys: columns of term structs (value, kind, dt, lang), those among names (others don't count). They are dealt to
        tasks; a task asks for ``batch`` of them at a time, as VALUES, and parses its answers there, so
        nothing passes the driver. A batch whose attempts all fail gives a row with error alone.
        """
        from tessera.plans.algebra import Term
        from tessera.plans.text import term

        url, timeout, bound = self.url, self.timeout, [c for c in keys.columns if c in names]

        def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for at in range(0, len(frame), batch):
                    rows = [" ".join(term(Term(**v)) if v is not None else "UNDEF" for v in r) for r in frame[bound].iloc[at : at + batch].itertuples(index=False, name=None)]
                    values = f"VALUES ({' '.join('?' + c for c in bound)}) {{ {' '.join(f'({r})' for r in rows)} }} " if bound else ""
                    asked = f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {values}{group} }}"
                    errors: list = []

                    def call(asked=asked, errors=errors):
                        try:
                            return Endpoint(url, timeout).run(asked)
                        except EndpointError as e:
                            errors.append(str(e))
                            raise OSError(str(e)) from e

                    answer = persistent(call, waits=waits)
                    if answer is None:
                        out.append(((None,) * len(names)) + ((errors or ["no answer"])[-1],))
                    else:
                        for b in answer["results"]["bindings"]:
                            out.append((*(_term(b.get(n)) for n in names), None))
                yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

        kind = "struct<value:string,kind:string,dt:string,lang:string>"
        return keys.distinct().mapInPandas(over, ", ".join(f"`{n}` {kind}" for n in names) + ", error string")

    def select(self, spark: SparkSession, query: str) -> DataFrame:
        """One string column for each variable, null where it is unbound. The answer passes the driver."""
        answer = self.run(query)
        names = answer["head"]["vars"]
        rows = [tuple(b[n]["value"] if n in b else None for n in names) for b in answer["results"]["bindings"]]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
