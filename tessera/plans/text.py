"""Algebra as SPARQL text again, for what an endpoint has to answer."""

from __future__ import annotations

from tessera.plans.algebra import Path, Term, Var


def term(t) -> str:
    if isinstance(t, Var):
        return f"?{t.name}"
    if t.kind == "uri":
        return f"<{t.value}>"
    if t.kind == "bnode":
        return t.value
    text = t.value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"' + (f"@{t.lang}" if t.lang else f"^^<{t.dt}>" if t.dt else "")


def path(p) -> str:
    if not isinstance(p, Path):
        return term(p)
    parts = [path(x) for x in p.args]
    return {"inv": "^({0})", "seq": "({0}/{1})", "alt": "({0}|{1})", "star": "({0})*", "plus": "({0})+", "opt": "({0})?"}[p.kind].format(*parts)


def expression(e: tuple) -> str:
    k = e[0]
    if k in ("var", "term"):
        return f"?{e[1]}" if k == "var" else term(e[1])
    if k in ("and", "or"):
        return "(" + (" && " if k == "and" else " || ").join(map(expression, e[1:])) + ")"
    if k == "not":
        return f"!({expression(e[1])})"
    if k == "in":
        return f"({expression(e[1])} IN ({', '.join(map(expression, e[2]))}))"
    if k == "call":
        return f"{e[1]}({', '.join(map(expression, e[2]))})"
    if k in ("exists", "not exists"):
        return f"{k.upper()} {{ {group(e[1])} }}"
    return f"({expression(e[1])} {k} {expression(e[2])})"


def group(node: tuple) -> str:
    """The inside of a group of patterns."""
    k = node[0]
    if k == "bgp":
        return " ".join(f"{term(t.s)} {path(t.p)} {term(t.o)} ." for t in node[1])
    if k == "join":
        return f"{{ {group(node[1])} }} {{ {group(node[2])} }}"
    if k == "left":
        test = f" FILTER({expression(node[3])})" if node[3] else ""
        return f"{group(node[1])} OPTIONAL {{ {group(node[2])}{test} }}"
    if k == "union":
        return f"{{ {group(node[1])} }} UNION {{ {group(node[2])} }}"
    if k == "filter":
        return f"{group(node[1])} FILTER({expression(node[2])})" if node[2][0] not in ("exists", "not exists") else f"{group(node[1])} FILTER {expression(node[2])}"
    if k == "values":
        rows = " ".join("(" + " ".join(map(term, r)) + ")" for r in node[2])
        return f"VALUES ({' '.join('?' + v for v in node[1])}) {{ {rows} }}"
    if k == "service":
        return f"SERVICE <{node[1]}> {{ {group(node[2])} }}"
    if k == "empty":
        return ""
    raise ValueError(k)


def variables(node) -> list[str]:
    """The variables that solutions of a node have, in order."""
    k = node[0]
    if k == "bgp":
        return list(dict.fromkeys(x.name for t in node[1] for x in (t.s, t.p, t.o) if isinstance(x, Var)))
    if k in ("join", "left", "union"):
        return list(dict.fromkeys([*variables(node[1]), *variables(node[2])]))
    if k == "filter":
        return variables(node[1])
    if k == "values":
        return list(node[1])
    return variables(node[2]) if k == "service" else []
