"""Equality in inference, seeded paths, pattern unfolding and entity classes against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators import identity, reason

E = "http://e/"
SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


def triples(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "uri", r[4] if len(r) > 4 else "", "") for r in rows], SCHEMA)


def closed_by_hand(data, schema):
    """The rules of SURVEY 2.11 applied one by one until nothing is new, equality with them."""
    facts = {r[:3] for r in data} | {r[:3] for r in schema}
    while True:
        of = {}
        for s, p, o in facts:
            of.setdefault(p, []).append((s, o))
        new = set()
        same = [(a, b) for a, b in of.get(T.SAME_AS, ())]
        new |= {(b, T.SAME_AS, a) for a, b in same} | {(a, T.SAME_AS, d) for a, b in same for c, d in same if b == c}
        for a, b in same:
            for s, p, o in facts:
                if a in (s, p, o):
                    new |= {(b if s == a else s, p, o), (s, b if p == a else p, o), (s, p, b if o == a else o)}
        for p, q in of.get(T.SUB_PROPERTY, ()):
            new |= {(s, q, o) for s, o in of.get(p, ())}
        for p, q in of.get(T.INVERSE, ()):
            new |= {(o, q, s) for s, o in of.get(p, ())} | {(o, p, s) for s, o in of.get(q, ())}
        for p, kind in of.get(T.TYPE, ()):
            if kind == T.TRANSITIVE:
                new |= {(a, p, d) for a, b in of.get(p, ()) for c, d in of.get(p, ()) if b == c}
        for p, c in of.get(T.DOMAIN, ()):
            new |= {(s, T.TYPE, c) for s, _ in of.get(p, ())}
        for p, c in of.get(T.RANGE, ()):
            new |= {(o, T.TYPE, c) for _, o in of.get(p, ())}
        for c, d in of.get(T.SUB_CLASS, ()):
            new |= {(s, T.TYPE, d) for s, k in of.get(T.TYPE, ()) if k == c}
        if new <= facts:
            return facts
        facts |= new


@pytest.mark.parametrize("seed", range(4))
def test_inference_with_equality_equals_brute_force(spark, seed):
    r = random.Random(seed)
    things, props, classes = [E + x for x in "abcdefgh"], [E + "p" + x for x in "123"], [E + "C" + x for x in "123"]
    schema = [(props[0], T.SUB_PROPERTY, props[1]), (props[2], T.INVERSE, props[1]), (props[0], T.DOMAIN, classes[0]), (props[1], T.RANGE, classes[1]), (classes[0], T.SUB_CLASS, classes[2])]
    if seed % 2:
        schema += [(props[1], T.TYPE, T.TRANSITIVE), (E + "alias", T.SUB_PROPERTY, T.SAME_AS)]
    if seed == 3:
        schema.append((classes[1], T.SAME_AS, classes[2]))
    data = [(r.choice(things), r.choice(props), r.choice(things)) for _ in range(8)] + [(r.choice(things), T.TYPE, r.choice(classes)) for _ in range(3)]
    data += [(r.choice(things), T.SAME_AS if seed != 1 else E + "alias", r.choice(things)) for _ in range(3)]
    if seed == 2:
        data.append((props[0], T.SAME_AS, E + "pz"))
        data.append((things[0], E + "pz", things[1]))
    want = closed_by_hand(data, schema)
    told = lambda facts: {f for f in facts if f[1] != T.SAME_AS and f[0] in things}
    result = reason.close(triples(spark, data), triples(spark, schema))
    got = {(x.s, x.p, x.o) for x in result.export().collect()}
    assert told(got) == told(want)
    components = {}
    for a, p, b in want:
        if p == T.SAME_AS and a in things:
            components.setdefault(a, {a}).add(b)
    mine = {x.id: x.canonical for x in result.canonical.collect()} if result.canonical is not None else {}
    for name in things:
        assert mine.get(name, name) == min(components.get(name, {name}))
    asked = spark.createDataFrame([(things[0],), (things[1],)], "name string")
    facts = {(x.s, x.p, mine.get(x.o, x.o)) for x in result.about(asked).collect() if x.p != T.SAME_AS}
    assert facts == {(s, p, mine.get(o, o)) for s, p, o in told(want) if s in things[:2] and mine.get(p, p) == p}


def test_components_are_merged_link_by_link(spark):
    r = random.Random(4)
    names = [f"n{k:03d}" for k in range(80)]
    links, canonical = [], None
    for _ in range(4):
        more = [(r.choice(names), r.choice(names)) for _ in range(15)]
        more = [x for x in more if x[0] != x[1]]
        links += more
        canonical = identity.merge(canonical, spark.createDataFrame(more, "a string, b string"))
        whole = {x.id: x.canonical for x in identity.components(spark.createDataFrame(links, "a string, b string")).collect()}
        assert {x.id: x.canonical for x in canonical.collect()} == whole


def test_violations_follow_chains_of_names(spark):
    o = T.OWL
    schema = triples(spark, [(E + "A", T.DISJOINT, E + "B")])
    data = triples(spark, [(E + "i", T.SAME_AS, E + "k"), (E + "k", T.SAME_AS, E + "j"), (E + "i", o + "differentFrom", E + "j"), (E + "i", T.TYPE, E + "A"), (E + "j", T.TYPE, E + "B"), (E + "z", T.TYPE, E + "B")])
    want = {("different", E + "i", E + "j"), ("disjoint", E + "i", f"{E}A {E}B")}
    assert {tuple(x) for x in reason.violations(data, schema).collect()} == want
    closed = {tuple(x) for x in reason.violations(reason.close(data, schema), schema).collect()}
    assert {x[:2] for x in closed} == {("different", E + "i"), ("disjoint", E + "i")}
    assert {x[:2] for x in reason.violations(reason.infer(data, schema), schema).collect()} >= {x[:2] for x in want}
    equal = triples(spark, [(E + "B", T.SAME_AS, E + "D"), (E + "A", T.DISJOINT, E + "D")])
    assert {x.rule for x in reason.violations(data.where(F.col("p") == T.TYPE).unionByName(triples(spark, [(E + "i", T.TYPE, E + "B")])), equal).collect()} == {"disjoint"}


@pytest.mark.parametrize("local", [True, False])
def test_closures_by_driver_and_by_spark_agree(spark, monkeypatch, local):
    if not local:
        monkeypatch.setattr(reason, "LOCAL_PAIRS", 3)
    r = random.Random(1)
    edges = {(r.choice("abcdefgh"), r.choice("abcdefgh")) for _ in range(12)}
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    assert {tuple(x) for x in reason.schema_closure(df).collect()} == reach
    seeds = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert {tuple(x)[:2] for x in reason.reach(df, seeds).collect()} == {("a", "a"), ("zz", "zz")} | {x for x in reach if x[0] == "a"}
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    depth = {tuple(x) for x in reason.closure(df, spark.createDataFrame([(n,) for n in nodes], "id string")).collect()}
    assert {x[:2] for x in depth} == reach | {(n, n) for n in nodes} and len(depth) == len({x[:2] for x in depth})


# ------------------------------------------------------------------ unfolding


def mapped(spark):
    """Maps with every kind of rule: keys or none, shared subjects, conditions, lists, joins, blanks."""
    from tessera.operators.mapping import Join, Lookup, Rule, TripleMap
    from tessera.plans.unfold import MappedGraph

    r = random.Random(7)
    blank = lambda x: r.choice([x, x, x, None, "", "\\N"])
    works = [(k // 2, r.randint(1, 4), blank(f"title {k % 5}/ü"), blank(r.choice(["a;b", "b ; c", "a"])), r.choice([None, 3, 10, -2]), float(k % 3), blank(E + "x/" + str(k % 3)), r.choice("pq")) for k in range(24)]
    people = [(k, f"name {k % 3}", r.choice([1, 2, 9])) for k in range(6)]
    sources = {
        "works": spark.createDataFrame(works, "id long, person int, title string, tags string, year int, rate double, link string, kind string"),
        "people": spark.createDataFrame(people, "pid long, name string, boss int"),
        "codes": spark.createDataFrame([("p", "paper"), ("q", "quill")], "code string, full string"),
    }
    w = E + "work/{id}"
    maps = [
        TripleMap("work", "works", w, (E + "Work",), rules=(Rule(T.LABEL, column="title", lang="en"), Rule(E + "year", column="year", datatype=T.XSD + "integer"), Rule(E + "by", iri=E + "person/{person}"), Rule(E + "self", iri=E + "work/{id}"), Rule(E + "rate", column="rate", datatype=T.XSD + "double"))),
        TripleMap("extra", "works", w, (), when="kind = 'p'", rules=(Rule(E + "tag", column="tags", split=";"), Rule(E + "link", column="link", as_iri=True), Rule(E + "year", column="person", datatype=T.XSD + "integer", when="year > 0"), Rule(E + "pair", iri=E + "{kind}{person}"), Rule(E + "loud", sql="upper(title)"))),
        TripleMap("person", "people", E + "person/{pid}", (E + "Person", E + "Agent"), rules=(Rule(E + "name", column="name"), Rule(T.LABEL, column="name")), joins=(Join(E + "boss", "person", (("boss", "pid"),)),), key=("pid",)),
        TripleMap("credit", "works", E + "credit/{id}/{person}", (E + "Credit",), rules=(Rule(E + "of", iri=E + "work/{id}"), Rule(E + "by", iri=E + "person/{person}")), joins=(Join(E + "wrote", "person", (("person", "pid"),)),)),
        TripleMap("coded", "works", E + "coded/{id}", (), rules=(Rule(E + "full", column="full"),), lookups=(Lookup("codes", "kind", 0, 1, "full"),)),
    ]
    return MappedGraph(maps, sources)


PATTERNS = [
    "?s a <e:Work>", "?s <e:year> ?y", "?s a <e:Work> ; <e:year> ?y ; <rdfs:label> ?t", "?s <e:by> ?p . ?p <e:name> ?n", "?c a <e:Credit> ; <e:by> ?p ; <e:of> ?w . ?p <e:name> ?n . ?w <e:year> ?y",
    "?s ?p ?o", "?s ?p <e:person/2>", "<e:work/3> ?p ?o", "<e:work/3> <e:by> ?x", "?s <e:by> <e:person/1> ; <e:tag> ?t", '?s <e:tag> "b"', "?s <e:link> ?l . ?m <e:link> ?l", "?s <e:boss> ?b . ?b <e:boss> ?c", "?s <e:self> ?s",
    "?s <e:pair> ?x", '?s <rdfs:label> "title 1/ü"@en', '?s <rdfs:label> "name 1"', "?s <e:year> 3", "?s <e:year> ?y ; <e:rate> ?r", '?s <e:rate> 2', "?s a ?c ; <e:name> ?n", "?x <e:of>/<e:by> ?p", "?p ^<e:by>/<e:year> ?y",
    "?s <e:boss>* ?b", "<e:person/4> <e:boss>* ?b", "?s <e:boss>+ <e:person/1>", "?s a <e:Credit> ; <e:wrote> ?p . ?p <e:boss>? ?q", "?s <e:full> ?f ; ?p ?g", "?c <e:wrote> ?p ; <e:by> ?p", "?s <e:loud> ?l", "<e:work/1> a <e:Work>", "?s <e:none> ?o", "?s <e:by> <e:nobody/1>",
    "?a <e:boss> ?b . ?c <e:of> ?w . ?c <e:by> ?a", "?p a <e:Agent> . ?c <e:of> ?w ; <e:by> ?p . ?w <e:tag> ?t", "?s <e:by> ?p OPTIONAL { ?p <e:name> ?n }", "?s <e:year> ?y FILTER NOT EXISTS { ?s <e:tag> ?t }", "?b <e:boss>*/<e:name> ?n . ?w <e:by> ?b", "?s ?p ?p", "?s <rdfs:label> ?t . ?s2 <rdfs:label> ?t",
]


@pytest.mark.parametrize("chunk", range(4))
def test_unfolded_patterns_equal_those_over_triples(spark, chunk):
    from collections import Counter

    from tessera.plans import sparql
    from tessera.plans.algebra import Engine

    graph = mapped(spark)
    triples_ = spark.createDataFrame(graph.triples().collect(), SCHEMA)
    for body in PATTERNS[chunk::4]:
        text = "SELECT * WHERE { " + body.replace("<e:", f"<{E}").replace("<rdfs:", f"<{T.RDFS}") + " }"
        bags = [Counter(tuple(sorted((k, str(v)) for k, v in x.asDict().items())) for x in sparql.query(Engine({"": d}), text).collect()) for d in (graph, triples_)]
        assert bags[0] == bags[1], body


def test_unfolded_scans_read_what_they_need(spark, tmp_path):
    from tessera.operators.mapping import Rule, TripleMap
    from tessera.plans import sparql
    from tessera.plans.algebra import Engine
    from tessera.plans.unfold import MappedGraph

    spark.createDataFrame([(k, f"n{k}", k % 3, "x") for k in range(20)], "id long, name string, boss long, more string").write.parquet(f"{tmp_path}/t.parquet")
    m = TripleMap("t", "t", E + "t/{id}", (E + "T",), rules=(Rule(E + "name", column="name"), Rule(E + "boss", iri=E + "t/{boss}"), Rule(E + "more", column="more")), key=("id",))
    engine = Engine({"": MappedGraph([m], {"t": spark.read.parquet(f"{tmp_path}/t.parquet")})})
    plan = lambda text: sparql.query(engine, text)._jdf.queryExecution().executedPlan().toString()
    one = plan(f'SELECT ?n WHERE {{ ?s a <{E}T> ; <{E}name> ?n ; <{E}boss> <{E}t/2> }}')
    assert "Generate" not in one and "Exchange" not in one and "EqualTo(boss,2)" in one and "more" not in one
    count = plan(f"SELECT (COUNT(?s) AS ?k) WHERE {{ ?s <{E}boss> ?b . ?b <{E}name> ?n }}")
    assert "http" not in count and "more" not in count  # joined by numbers, no IRI is built
    assert sparql.query(engine, f"SELECT (COUNT(?s) AS ?k) WHERE {{ ?s <{E}boss> ?b . ?b <{E}name> ?n }}").first().k == 20


def test_seeded_paths_read_what_they_reach(spark):
    from tessera.plans import sparql
    from tessera.plans.algebra import Engine

    chains = [(f"{E}{c}{k}", E + "up", f"{E}{c}{k + 1}") for c in "abcdefghij" for k in range(6)]
    engine = Engine({"": triples(spark, chains)})
    seen = []
    whole = reason.reach

    def counted(edges, seeds):
        out = whole(edges, seeds)
        seen.append(out.count())
        return out

    from tessera.plans import algebra

    algebra.reach, old = counted, algebra.reach
    try:
        rows = sparql.query(engine, f"SELECT ?x WHERE {{ ?x <{E}up>* <{E}c6> }}").collect()
        both = sparql.query(engine, f"SELECT ?y WHERE {{ ?x <{E}up> <{E}d1> . ?x <{E}up>* ?y }}").collect()
    finally:
        algebra.reach = old
    assert {r.x for r in rows} == {f"{E}c{k}" for k in range(7)} and {r.y for r in both} == {f"{E}d{k}" for k in range(7)}
    assert seen == [7, 7]  # of 10 chains only one is walked


# ------------------------------------------------------------------ entities by classes


def crowd(r, n, alternates):
    names = ["ann lee", "lee ann", "ann", "bo lee park", "park", "li", "ann li", "lee", "", "maria jose park lee", "bo", "jose"]
    toks = lambda: r.choice(names).split()
    out = []
    for k in range(n):
        row = [k, toks(), r.choice([None, 1900, 1901, 1950]), r.choice([None, 1960, 1970])]
        out.append((*row[:2], [toks() for _ in range(r.randint(0, 2))] if r.random() < 0.8 else None, *row[2:], r.choice(["clean", "uncertain"])) if alternates else tuple(row))
    return out


@pytest.mark.parametrize("seed, cell", [(1, 5000), (2, 2), (3, 1)])
def test_entities_by_classes_equal_pairs_by_hand(spark, monkeypatch, seed, cell):
    """Also with tokens dealt to grids of one or two names a cell."""
    from collections import Counter

    from tessera.operators import entity

    monkeypatch.setattr(entity, "CELL", cell)
    r = random.Random(seed)
    left, right = crowd(r, 40, False), crowd(r, 50, True)
    ldf = spark.createDataFrame(left, "id int, tokens array<string>, birth int, death int")
    rdf = spark.createDataFrame(right, "id int, tokens array<string>, alternates array<array<string>>, birth int, death int, birth_outcome string")
    long = lambda ts: {t for t in ts if len(t) >= 4}
    every = lambda b: set(b[1]).union(*map(set, b[2] or []))

    def match(a, b):
        a, b = set(a), set(b)
        return bool(a and b) and (len(a & b) >= 2 or a <= b or b <= a)

    def dates(a, b):
        close = [abs(x - y) <= 3 for x, y in ((a[2], b[3]), (a[3], b[4])) if x is not None and y is not None]
        return all(close) if close else None

    pairs = [(a, b) for a in left for b in right if long(a[1]) & every(b)]
    assert sorted(map(tuple, entity.block(ldf, rdf).collect())) == sorted((a[0], b[0]) for a, b in pairs)
    want = Counter(a[0] for a, _ in pairs)
    assert {x.id: x.n_candidates for x in entity.candidate_counts(ldf, rdf).collect()} == want
    matched = [(a, b) for a, b in pairs if match(a[1], b[1]) or any(match(a[1], o) for o in b[2] or [])]
    least = lambda rows, key: {k: min(x[0] for x in rows if key(x) == k) for k in map(key, rows)}
    lk = lambda a: frozenset(a[1])
    rk = lambda b: (frozenset(b[1]), frozenset(map(frozenset, b[2] or [])))
    lc, rc = least(left, lk), least(right, rk)
    tally = Counter()
    for a, b in matched:
        d = dates(a, b)
        outcome = "inconclusive" if d is None else "confirmed" if d else "rejected"
        tally[lc[lk(a)], rc[rk(b)], outcome, "low" if d is None else None if not d else "high" if b[5] == "clean" else "medium"] += 1
    found = entity.outcomes(ldf, rdf)
    assert {tuple(x)[:4]: x.pairs for x in found.collect()} == tally
    judged = entity.judge(entity.block(ldf, rdf), ldf, rdf)
    assert entity.funnel(judged).collect() == entity.funnel_of(found).collect()


def test_class_matches_make_no_pairs_of_people(spark):
    """A thousand bearers of each of three names meet as three names."""
    from tessera.operators import entity

    names = [["john", "smith"], ["john", "jones"], ["mary", "smith"]]
    people = spark.range(3000).select(F.col("id"), F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in names)), (F.col("id") % 3 + 1).cast("int")).alias("tokens"))
    found = entity.class_matches(entity.classes(people), entity.classes(people))
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_rules_by_hand_and_by_spark_agree(spark):
    schema = triples(spark, [
        (E + "p", T.INVERSE, E + "q"), (E + "q", T.SUB_PROPERTY, E + "r"), (E + "r", T.DOMAIN, E + "D"), (E + "p", T.RANGE, E + "U"), (E + "D", T.SUB_CLASS, E + "Top"), (E + "r", T.TYPE, T.TRANSITIVE),
        (E + "U", T.OWL + "unionOf", "_:l", "bnode"), ("_:l", T.RDF + "first", E + "D"), ("_:l", T.RDF + "rest", "_:m", "bnode"), ("_:m", T.RDF + "first", E + "X"), ("_:m", T.RDF + "rest", T.RDF + "nil"), (E + "Top", T.SUB_CLASS, E + "D"),
    ])
    a, b = reason.rules_of(schema), reason._rules_by_spark(schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a.implied) == rows(b.implied) and rows(a.says) == rows(b.says) and rows(a.above) == rows(b.above) and a.transitive == b.transitive


# ------------------------------------------------------------------ loose joins, reports, sources


def test_loose_joins_equal_brute_force(spark):
    """Variables that may be unbound agree with anything; bags of solutions, no nested loop."""
    from collections import Counter

    from tessera.plans.algebra import compatible_join

    r = random.Random(3)
    term = "struct<value:string,kind:string,dt:string,lang:string>"
    some = lambda p: None if r.random() < p else (r.choice("xyz"), "uri", "", "")
    a = [((r.choice("kl"), "uri", "", ""), some(0.3), some(0), (str(i), "uri", "", "")) for i in range(25)]
    b = [((r.choice("kl"), "uri", "", ""), some(0.3), some(0.4), (str(i), "uri", "", "")) for i in range(20)]
    da = spark.createDataFrame(a, f"t {term}, u {term}, w {term}, a {term}")
    db = spark.createDataFrame(b, f"t {term}, u {term}, w {term}, b {term}")
    fits = lambda x, y: x[0] == y[0] and all(p is None or q is None or p == q for p, q in zip(x[1:3], y[1:3]))
    pairs = [(x, y) for x in a for y in b if fits(x, y)]
    both = [(x[0], x[1] or y[1], x[2] or y[2], x[3], y[3]) for x, y in pairs]
    lone = [(*x, None) for x in a if not any(fits(x, y) for y in b)]
    v = lambda t: None if t is None else t[0]
    want = {"inner": both, "left": both + lone, "left_semi": [x for x in a if any(fits(x, y) for y in b)], "left_anti": [x[:4] for x in lone]}
    for how, rows in want.items():
        out = compatible_join(da, db, how, frozenset("u"), frozenset("uw"))
        got = Counter(tuple(v(row[c]) for c in ("t", "u", "w", "a", "b") if c in out.columns) for row in out.collect())
        assert got == Counter(tuple(map(v, x)) for x in rows), how
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_two_optionals_share_a_variable_without_a_nested_loop(spark):
    from tessera.plans import sparql
    from tessera.plans.algebra import Engine

    data = triples(spark, [(E + "a", E + "p", E + "1"), (E + "b", E + "q", E + "2"), (E + "c", E + "p", E + "3"), (E + "c", E + "q", E + "4"), (E + "c", E + "q", E + "3")] + [(E + x, T.TYPE, E + "T") for x in "abcd"])
    out = sparql.query(Engine({"": data}), f"SELECT ?s ?v WHERE {{ ?s a <{E}T> OPTIONAL {{ ?s <{E}p> ?v }} OPTIONAL {{ ?s <{E}q> ?v }} }}")
    assert sorted((r.s[-1], r.v and r.v[-1]) for r in out.collect()) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", None)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_least_and_greatest_keep_terms(spark):
    from tessera.plans import sparql
    from tessera.plans.algebra import Engine

    xsd = T.XSD
    data = triples(spark, [(E + "a", E + "n", "2.50", "literal", xsd + "decimal"), (E + "b", E + "n", "10", "literal", xsd + "integer"), (E + "c", E + "t", "x", "literal"), (E + "d", E + "t", "Y", "literal")])
    ask = lambda p: tuple(sparql.query(Engine({"": data}), f"SELECT (MIN(?o) AS ?a) (MAX(?o) AS ?b) WHERE {{ ?s <{E}{p}> ?o }}").first())
    assert ask("n") == ("2.50", "10") and ask("t") == ("Y", "x") and ask("none") == (None, None)


ESCAPED = """
prefixes: {ex: "http://e/", f: "http://f/"}
mappings:
  T:
    sources: [['rows.csv~csv']]
    s: ex:row/$(id)
    po:
      - p: ex:name
        o:
          function: f:escape
          parameters:
            - parameter: f:valueParameter
              value: {function: f:string_split, parameters: [[f:valueParameter, $(names)], [f:p_string_sep, ","]]}
            - [f:modeParameter, url]
      - p: ex:flag
        o: "yes"
        condition:
          function: f:boolean_and
          parameters:
            - parameter: f:param_rep_b
              value:
                - {function: f:notEqual, parameters: [[f:a, $(value)], [f:b, "\\\\N"]]}
                - {function: f:notEqual, parameters: [[f:a, $(value)], [f:b, ""]]}
"""


def test_escape_of_each_piece_and_conditions_together(spark):
    yaml = pytest.importorskip("yaml")
    assert yaml
    from tessera.operators.mapping import apply
    from tessera.plans.unfold import MappedGraph
    from tessera.sources.mappings import parse_mappings

    rows = spark.createDataFrame([("r1", "Her self, Host", "5"), ("r2", "A/b,,C", "x"), ("r3", None, "\\N"), ("r4", "", "")], "id string, names string, value string")
    (m,) = parse_mappings(ESCAPED)
    want = {("r1", "name", "Her%20self"), ("r1", "name", "Host"), ("r2", "name", "A%2Fb"), ("r2", "name", "C"), ("r1", "flag", "yes"), ("r2", "flag", "yes")}
    tell = lambda df: {(r.s[-2:], r.p[len(E):], r.o) for r in df.collect()}
    assert tell(apply(m, {"rows.csv": rows})) == want == tell(MappedGraph([m], {"rows.csv": rows}).triples())


def test_dump_is_counted_and_filtered_in_one_read(spark, tmp_path):
    import gzip
    import json

    from pyspark.sql import Observation

    from tessera.functions import scalar
    from tessera.sources import files

    born = ["1901", "ca. 1850", "", "19th century", None]
    rows = [{"name": f"n{k}", "birth_date": born[k % 5]} | ({"remote_ids": {"wikidata": f"Q{k}"}} if k % 3 == 0 else {"remote_ids": {"viaf": "7"}}) for k in range(60)]
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("short\n/type/work\t/works/W\t1\tx\t{}\n")
        f.writelines(f"/type/author\t/authors/{k}\t1\tx\t{json.dumps({a: b for a, b in r.items() if b is not None})}\n" for k, r in enumerate(rows))
    seen = Observation()
    outcome = scalar.parse_year(F.coalesce(F.get_json_object("raw", "$.birth_date"), F.lit("")))[1]
    kinds = {k: F.count_if(F.col("raw").isNotNull() & (outcome == k)) for k in ("clean", "uncertain", "absent", "century")}
    df = files.read_dump(spark, str(tmp_path / "d.txt.gz"), needs='"wikidata"', counters=seen, measures=kinds)
    assert sorted(int(r.key.rsplit("/", 1)[1]) for r in df.collect()) == list(range(0, 60, 3))
    assert seen.get == {"lines": 62, "records": 60, "needed": 20, "clean": 12, "uncertain": 12, "absent": 24, "century": 12}
    whole = files.read_dump(spark, str(tmp_path / "d.txt.gz"))
    assert whole.count() == seen.get["records"]  # a second, full pass agrees
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan text") == 1


def test_quads_and_cells_of_several_values(spark, tmp_path):
    from tessera.operators import prepare
    from tessera.sources import files

    quads = triples(spark, [(E + "a", E + "p", 'x "y"', "literal"), (E + "a", E + "q", "_:b", "bnode")]).withColumn("graph", F.when(F.col("o_kind") == "literal", E + "g"))
    files.write_nquads(quads, str(tmp_path / "q"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "q")).collect())
    assert lines == [f'<{E}a> <{E}p> "x \\"y\\"" <{E}g> .', f"<{E}a> <{E}q> _:b ."]
    assert {(r.s, r.o) for r in files.read_ntriples(spark, str(tmp_path / "q")).collect()} == {(E + "a", 'x "y"'), (E + "a", "_:b")}
    df = spark.createDataFrame([("a,b", "x"), ("\\N", "y,z,"), (None, "q"), ("c", "")], "one string, two string")
    assert {r["column"]: r.n for r in prepare.multi_counts(df).collect()} == {"one": 1, "two": 1}


def test_strategies_are_measured_without_their_rows(spark, tmp_path):
    from tessera.operators import federation

    spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/l")
    spark.range(50).select((F.col("id") * 3).alias("k"), F.lit("x").alias("n")).write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    found = federation.run(federation.strategies(right, left, "k", single=lambda: left.join(right, "k"), blind=lambda: left.join(right.where("n = 'y'"), "k"), nested=lambda: left.union(left).join(right, "k")), "single", spark)
    by = {m.strategy: m for m in found}
    assert [by[k].equal for k in ("single", "naive", "optimised", "nested", "blind")] == [True, True, True, False, False]
    assert by["single"].rows == 50 and by["nested"].rows == 100 and all(m.jobs > 0 and m.input_bytes > 0 for m in found)
    assert by["naive"].shuffle_bytes > by["optimised"].shuffle_bytes
    assert {r.strategy: r.rows for r in federation.table(spark, found).collect()} == {m.strategy: m.rows for m in found}


@pytest.mark.parametrize("seed", range(4))
def test_extended_closure_equals_a_new_one(spark, seed):
    r = random.Random(seed)
    things, props, classes = [E + x for x in "abcdefghij"], [E + "p" + x for x in "123"], [E + "C" + x for x in "123"]
    schema = triples(spark, [(props[0], T.SUB_PROPERTY, props[1]), (props[2], T.INVERSE, props[1]), (props[0], T.DOMAIN, classes[0]), (props[1], T.RANGE, classes[1]), (classes[0], T.SUB_CLASS, classes[2]), (props[1], T.TYPE, T.TRANSITIVE)])
    fact = lambda: (r.choice(things), r.choice(props), r.choice(things)) if r.random() < 0.8 else (r.choice(things), T.TYPE, r.choice(classes))
    first, more = [fact() for _ in range(9)], [fact() for _ in range(3)]
    if seed:
        first.append((things[0], T.SAME_AS, things[1]))
    if seed > 1:
        more.append((things[1], T.SAME_AS, things[2 if seed == 2 else 9]))
    if seed == 3:
        more.append((classes[0], T.SAME_AS, classes[1]))
    old = reason.close(triples(spark, first), schema)
    got, want = reason.extend(old, triples(spark, more), schema), reason.close(triples(spark, first + more), schema)
    rows = lambda df: sorted((x.s, x.p, x.o) for x in df.collect() if x.p != T.SAME_AS)
    assert rows(got.triples) == rows(want.triples)
    names = lambda c: {} if c is None else {x.id: x.canonical for x in c.collect()}
    assert names(got.canonical) == names(want.canonical)


def test_a_closed_dataset_stays_closed_and_only_new_facts_meet_the_rules(spark, monkeypatch):
    from tessera.sources.files import Catalog

    schema = triples(spark, [(E + "p", T.DOMAIN, E + "D"), (E + "D", T.SUB_CLASS, E + "Top")])
    cat = Catalog()
    cat.load("a", triples(spark, [(f"{E}s{k}", E + "p", E + "o") for k in range(200)]))
    cat.close("a", schema)
    seen = []
    spread = reason._spread
    monkeypatch.setattr(reason, "_spread", lambda x, rules: (seen.append(x.count()), spread(x, rules))[1])
    version = cat.version("a")
    cat.load("a", triples(spark, [(E + "new", E + "p", E + "o"), (E + "s0", E + "p", E + "o")]))
    assert seen == [2] and cat.version("a") > version
    assert cat.closed("a").triples.where(F.col("p") == T.TYPE).count() == 402


def test_facet_results_are_kept_until_a_load(spark):
    from tessera.operators import facets
    from tessera.sources.files import Catalog

    rows = [(f"{E}w{k}", T.TYPE, E + "W") for k in range(60)] + [(f"{E}w{k}", E + "c", f"{E}c{k % 4}") for k in range(60)] + [(f"{E}w{k}", E + "d", f"{E}d{k % 3}") for k in range(0, 60, 2)]
    cat = Catalog()
    cat.load("a", triples(spark, rows))
    results = facets.Results(cat, "a", [E + "c", E + "d"], [T.LABEL])
    state = facets.State(E + "W", facets=(facets.Facet(E + "c", "enum", (E + "c1", E + "c2")),))

    def look(s):
        spark.sparkContext.setJobGroup("facets", "facets")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("facets"))
        frames = results.counts(s), results.total(s)
        made = len(spark.sparkContext.statusTracker().getJobIdsForGroup("facets")) - before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return made, sorted(map(tuple, frames[0].collect())), tuple(frames[1].first())

    jobs, counted, total = look(state)
    triples_ = cat["a"]
    assert jobs > 0 and counted == sorted(map(tuple, facets.counts(triples_, state, [E + "c", E + "d"], [T.LABEL]).collect()))
    assert total == tuple(facets.total(triples_, state, [T.LABEL]).first()) == (30, False)
    assert look(facets.State(E + "W", 2, facets=state.facets)) == (0, counted, total)  # another page: no job at all
    cat.load("a", triples(spark, [(E + "x", T.TYPE, E + "W"), (E + "x", E + "c", E + "c1")]))
    jobs, counted, total = look(state)
    assert jobs > 0 and total == (31, False) and (E + "c", E + "c1", 16) in counted
