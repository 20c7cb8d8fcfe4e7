"""Reader of mapping files in YARRRML: each mapping becomes a TripleMap, functions become Spark SQL.

Read are: prefixes; CSV sources; subject templates; a condition for the rows of a mapping;
predicate-object lists in short and long form with datatypes, languages, IRIs, functions and
conditions; references to other mappings whose condition equates templates of like shape, which are
compared column by column. Look-ups in a file become left joins. Anything else is a ValueError.
"""

from __future__ import annotations

import re
from dataclasses import replace

from tessera.operators.mapping import Join, Lookup, Rule, TripleMap
from tessera.terms import TYPE

#: The names that a key may have (fixed values).
SUBJECTS, PREDICATES, OBJECTS, PAIRS = ("s", "subject", "subjects"), ("p", "predicate", "predicates"), ("o", "object", "objects"), ("po", "predicateobjects")

_PLACE = re.compile(r"\$\(([^)]*)\)")


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def joined(text: str) -> str:
    """SQL of a text with $(column) places; a missing column makes it null."""
    parts = _PLACE.split(text)
    found = [(f"`{p}`" if k % 2 else literal(p)) for k, p in enumerate(parts) if k % 2 or p]
    return found[0] if len(found) == 1 else f"concat({', '.join(found)})" if found else "''"


class _Reader:
    def __init__(self, doc: dict):
        self.prefixes = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#"} | (doc.get("prefixes") or {})
        self.lookups: list[Lookup] = []

    def iri(self, name: str) -> str:
        """A name with its prefix written out; templates and full IRIs as they are."""
        head, colon, rest = name.partition(":")
        return TYPE if name == "a" else self.prefixes[head] + rest if colon and head in self.prefixes else name

    def parameters(self, call: dict) -> dict[str, str]:
        """The SQL of each parameter by its local name, in their order."""
        out = {}
        for p in call.get("parameters") or []:
            name, value = (p["parameter"], p["value"]) if isinstance(p, dict) else p
            sql = [self.call(v) if isinstance(v, dict) else joined(str(v)) for v in (value if isinstance(value, list) else [value])]
            key = name.rpartition(":")[2]
            out |= {key if len(sql) == 1 else f"{key}{k}": v for k, v in enumerate(sql)}
        return out

    def call(self, call: dict) -> str:
        """The SQL of a function; empty and null are the same to it."""
        name, given = call["function"].rpartition(":")[2], self.parameters(call)
        args = list(given.values())
        if name in ("equal", "notEqual") and len(args) == 2:
            return f"coalesce({args[0]}, '') {'=' if name == 'equal' else '<>'} coalesce({args[1]}, '')"
        if name == "isNull":
            return f"coalesce({args[0]}, '') = ''"
        if name in ("boolean_and", "boolean_or"):
            return f" {name[8:].upper()} ".join(f"({a})" for a in args)
        if name == "boolean_not":
            return f"NOT ({args[0]})"
        if name == "controls_if":
            return f"if({given['bool_b']}, {given['any_true']}, {given.get('any_false', 'null')})"
        if name == "string_substring":
            start, end = given["param_int_i_from"].strip("'"), given.get("param_int_i_opt_to", "").strip("'")
            return f"substring({args[0]}, {int(start) + 1}{f', {int(end) - int(start)}' if end else ''})"
        if name == "lookup":
            key, file, a, b = (given[k] for k in ("str", "inputFile", "fromColumn", "toColumn"))
            wanted = (file.strip("'"), key, int(a.strip("'")), int(b.strip("'")))
            for known in self.lookups:
                if (known.source, known.key, known.from_column, known.to_column) == wanted:
                    return f"`{known.out}`"
            self.lookups.append(Lookup(*wanted, out=f"_lookup{len(self.lookups)}"))
            return f"`{self.lookups[-1].out}`"
        raise ValueError(f"unknown function: {call['function']}")

    def rule(self, predicate: str, o, extra: dict) -> Rule | Join:
        if isinstance(o, dict) and "mapping" in o:
            return self.join(predicate, o)
        extra = extra | (o if isinstance(o, dict) else {})
        when = self.call(extra["condition"]) if extra.get("condition") else None
        more = {"when": when, "datatype": self.iri(extra.get("datatype", "")), "lang": extra.get("language", "")}
        is_iri = extra.get("type") == "iri"
        name = o.get("function", "").rpartition(":")[2] if isinstance(o, dict) else ""
        if name == "escape":
            return self.escaped(predicate, o, is_iri, more)
        if name == "string_split":
            value, separator = list(self.parameters(o).values())
            return Rule(predicate, sql=value, split=re.escape(separator.strip("'")), as_iri=is_iri, **more)
        if isinstance(o, dict) and "function" in o:
            return Rule(predicate, sql=self.call(o), as_iri=is_iri, **more)
        text = str(o["value"] if isinstance(o, dict) else o)
        is_iri, text = is_iri or text.endswith("~iri"), text.removesuffix("~iri")
        if whole := _PLACE.fullmatch(text):
            return Rule(predicate, column=whole[1], as_iri=is_iri, **more)
        if is_iri:
            return Rule(predicate, iri=_PLACE.sub(r"{\1}", self.iri(text)), **more)
        return Rule(predicate, sql=joined(text), **more)

    def escaped(self, predicate: str, o: dict, is_iri: bool, more: dict) -> Rule:
        """escape() of a value, or of each piece of a split one."""
        given = {(p["parameter"] if isinstance(p, dict) else p[0]).rpartition(":")[2]: p["value"] if isinstance(p, dict) else p[1] for p in o["parameters"]}
        value, mode = given["valueParameter"], given.get("modeParameter", "url")
        if mode != "url":
            raise ValueError(f"unknown mode of escape: {mode}")
        inner = self.rule(predicate, value, {}) if isinstance(value, dict) else Rule(predicate, sql=joined(str(value)))
        return replace(inner, escape=True, as_iri=is_iri, **more)

    def join(self, predicate: str, o: dict) -> Join:
        on = []
        conditions = o.get("condition") or []
        for c in conditions if isinstance(conditions, list) else [conditions]:
            if c["function"].rpartition(":")[2] != "equal":
                raise ValueError(f"a reference can only join by equal: {c['function']}")
            given = {p[0].rpartition(":")[2]: str(p[1]) for p in c["parameters"]}
            child, parent = (_PLACE.split(given[k]) for k in ("str1", "str2"))
            if child[::2] != parent[::2] or len(child) < 2:
                raise ValueError(f"templates of a join differ in shape: {given}")
            on += zip(child[1::2], parent[1::2])
        return Join(predicate, o["mapping"], tuple(on))

    def mapping(self, name: str, m: dict) -> TripleMap:
        self.lookups = []
        source = (m.get("sources") or m.get("source"))[0]
        source = (source[0] if isinstance(source, list) else source).removesuffix("~csv")
        made = []
        for entry in next((m[k] for k in PAIRS if m.get(k)), []):
            if isinstance(entry, dict):
                ps, os = (next(entry[k] for k in keys if k in entry) for keys in (PREDICATES, OBJECTS))
                extra = {k: v for k, v in entry.items() if k not in PREDICATES + OBJECTS}
            else:
                ps, os, extra = entry[0], entry[1], {}
                if len(entry) > 2:
                    extra = {"language": entry[2].removesuffix("~lang")} if entry[2].endswith("~lang") else {"datatype": entry[2]}
            for p in ps if isinstance(ps, list) else [ps]:
                for o in os if isinstance(os, list) else [os]:
                    made.append(self.rule(self.iri(p), o, extra))
        subject = next(m[k] for k in SUBJECTS if k in m)
        when = self.call(m["condition"]) if m.get("condition") else None
        return TripleMap(name, source, _PLACE.sub(r"{\1}", self.iri(subject).removesuffix("~iri")), when=when, rules=tuple(r for r in made if isinstance(r, Rule)), joins=tuple(j for j in made if isinstance(j, Join)), lookups=tuple(self.lookups))


def parse_mappings(text: str) -> list[TripleMap]:
    """The maps of one file; sources and look-ups are named by their paths in it."""
    import yaml

    doc = yaml.safe_load(text)
    reader = _Reader(doc)
    return [reader.mapping(name, m) for name, m in (doc.get("mappings") or {}).items()]
