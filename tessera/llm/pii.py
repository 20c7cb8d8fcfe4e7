"""Personal data: overlapping candidates, boosted trees, calibrated thresholds, all in SQL functions.

Generators with high recall propose spans: the four base kinds, and national phone numbers, personal
ids and bank account numbers. Each candidate gets format features (digits, separators, checksum)
and context features (words before it, what touches it). Gradient-boosted trees, fitted in numpy on
the driver on made, labelled candidates whose features come from the same SQL, are written out as
CASE expressions, so scoring needs no Python on the executors. Scores are calibrated on held-out
candidates; each kind has a threshold with the precision asked for. Base findings stay whatever
the trees say; other candidates stay if accepted and clear of base findings.

Places come without a UDF: split() by a pattern gives what lies between its matches, so the sum of
lengths before a match is its start, in code points. Sums run in blocks, so that a text with many
matches takes little more than linear time; quantifiers are possessive where the pattern allows, so
that long runs take linear time.

Edge cases: null and empty texts have no findings; repeated rows are judged row by row; extra
columns are ignored by find() and kept by redact(). Texts may be of any length.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "national", "personal_id", "iban"]
BASE = 4
#: Base patterns (fixed values), rewritten to take linear time: a match begins where a run of its
#: characters does or where the last match ended. Cards are whole chains of 14 to 19 digits.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
]
#: What a text must hold for a pattern to be tried at all.
NEEDS = ["@", ".", None, "+", None, "-", None]
BEFORE, AFTER = 40, 8
PRECISION = 0.98
TREES, DEPTH, RATE = 24, 3, 0.3
_SUM_BLOCK = 128


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _bind(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(g: Column) -> Column:
    """Running sums of an array of longs (a lambda's variable), block by block."""
    last = F.floor((F.size(g) - 1) / _SUM_BLOCK).cast("int")

    def part(b):
        return F.slice(g, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))

    def inner(sums):
        def of_block(b):
            return _bind(part(b), lambda x: _bind(_total(F.slice(sums, F.lit(1), b)), lambda s: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: s + _total(F.slice(x, F.lit(1), i)))))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), of_block))

    return _bind(F.transform(F.sequence(F.lit(0), last), lambda b: _total(part(b))), inner)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Does the Luhn checksum of the digits hold?"""
    d = F.split(F.reverse(_digits(m)), "")
    d = F.filter(d, lambda x: x != "")
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0


def _fits(kind: int, m: Column) -> Column:
    """What a base match must pass."""
    n = F.length(_digits(m))
    if kind == 1:
        small = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(small, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, F.concat(F.lit("0"), p)).otherwise("999").cast("int") <= 255))
    if kind == 2:
        return _luhn(m)
    if kind == 3:
        return n.between(10, 15)
    return F.lit(True)


def _ok(e: Column) -> Column:
    return e.cast("double")


def features(c: Column) -> list[Column]:
    """Format and context features of a candidate (struct of kind, m, before, after)."""
    m, before, after = c["m"], c["before"], c["after"]
    d = _digits(m)
    return [
        c["kind"].cast("double"),
        F.length(m).cast("double"),
        F.length(d).cast("double"),
        F.length(F.regexp_replace(m, r"[^ .()-]", "")).cast("double"),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        _ok(F.coalesce(_luhn(m), F.lit(False))),
        _ok(before.rlike(r"[A-Za-z0-9_/#]$")),
        _ok(after.rlike(r"^(?:[A-Za-z0-9_/%]|[.-][0-9])")),
        _ok(before.rlike(r"(?i)(phone|tel|call|fax|mobile|cell|contact|reach)")),
        _ok(before.rlike(r"(?i)(ssn|social|passport|tax|identity|national)")),
        _ok(before.rlike(r"(?i)(iban|bank|account|transfer|pay)")),
        _ok(before.rlike(r"(?i)(order|isbn|version|invoice|item|total|sku|serial|ref|issue|page|part|ticket|build)")),
        _ok(m.startswith("(")),
    ]


NAMES = [f"f{k}" for k in range(14)]


# ---------------------------------------------------------------- boosted trees, fitted in numpy


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], g[order].cumsum(), h[order].cumsum()
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut >= 5) & (cut < len(v) - 6)]
        if not len(cut):
            continue
        gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    _, f, cut = best
    if f is None:
        return leaf
    left = x[:, f] < cut
    return (f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] < cut, _value(a, x), _value(b, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Gradient boosting of the logistic loss."""
    z, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        t = _tree(x, p - y, p * (1 - p), DEPTH)
        trees.append(t)
        z += RATE * _value(t, x)
    return trees


def _expression(tree, row: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(RATE * tree)
    f, cut, a, b = tree
    return F.when(row[NAMES[f]] < cut, _expression(a, row)).otherwise(_expression(b, row))


class Model:
    def __init__(self, trees: list, scale: float, shift: float, thresholds: list[float]):
        self.trees, self.scale, self.shift, self.thresholds = trees, scale, shift, thresholds

    def accepted(self, row: Column) -> Column:
        """Is a struct of features above its kind's threshold? (compared before the logistic function)"""
        z = functools.reduce(lambda a, b: a + b, [_expression(t, row) for t in self.trees])
        cuts = F.array(*(F.lit((np.log(t / (1 - t)) - self.shift) / self.scale) for t in self.thresholds))
        return z >= F.element_at(cuts, row[NAMES[0]].cast("int") + 1)


def made_candidates(n: int = 3000, seed: int = 3) -> list[tuple[str, int]]:
    """Texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = ["the", "and", "of", "with", "entre", "und", "para", "ihr", "nous", "was", "haben", "see", "meet"]
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 8)))

    def luhn(n):
        d = [int(c) for c in "4" + num(n - 2)]
        s = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        return "".join(map(str, d)) + str(-s % 10)

    good = [
        (["", "mail ", "write to "], lambda: f"{r.choice('abcxyz')}{num(2)}.{r.choice(words)}@{r.choice(words)}.example.com"),
        (["", "host ", "from "], lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))),
        (["", "card ", "paid with "], lambda: luhn(16)),
        (["", "call ", "tel "], lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"),
        (["call ", "phone: ", "tel. ", "contact me at ", "mobile "], lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])),
        (["ssn ", "SSN: ", "social security number ", "tax id "], lambda: f"{num(3)}-{num(2)}-{num(4)}"),
        (["iban ", "account ", "bank transfer to "], lambda: f"DE{num(2)}" + "".join(" " + num(4) for _ in range(4)) + " " + num(2)),
    ]
    bad = [
        (["version ", "build ", "", "part "], lambda: f"{num(4)}.{num(3)}.{num(5)}.{num(3)}"),
        (["order ", "serial ", "", "isbn ", "item "], lambda: "9" + num(14) + str(r.randint(0, 9))),
        (["ref ", "total ", "", "ticket "], lambda: f"+{num(1)}.{num(5)}-{num(5)}"),
        (["order ", "invoice ", "", "part ", "serial "], lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (["order ", "ref ", "", "item ", "page "], lambda: f"{num(3)}-{num(2)}-{num(4)}"),
        (["", "serial ", "sku ", "part ", "build "], lambda: f"{r.choice('ABCDE')}X{num(2)}{num(4)}{num(4)}{r.choice('QRS')}{num(3)}"),
        (["https://example.com/", "x", "#"], lambda: f"{num(3)}-{num(2)}-{num(4)}"),
    ]
    out = []
    for k in range(n):
        leads, make = r.choice(good if k % 2 else bad)
        out.append((f"{prose()} {r.choice(leads)}{make()}{r.choice([' ', '. ', ', '])}{prose()}", k % 2))
    return out


_models: dict = {}


def trained(spark: SparkSession, seed: int = 0) -> Model:
    """Fit on made candidates; their features come from the same expressions as in find()."""
    key = seed
    if key not in _models:
        made = made_candidates()
        rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(made)], "id long, text string, y int")
        rows = rows.select("id", "y", F.explode(F.flatten(F.array(*(candidates(F.col("text"), k) for k in range(len(KINDS)))))).alias("c"))
        got = rows.select("id", "y", "c.kind", *(f.alias(n) for f, n in zip(features(F.col("c")), NAMES))).orderBy("id", "kind", "c.s").collect()
        x, y = np.array([[r[n] for n in NAMES] for r in got], float), np.array([r.y for r in got], float)
        held = np.random.default_rng(seed).random(len(x)) < 0.3
        trees = boost(x[~held], y[~held])
        z = sum(RATE * _value(t, x[held]) for t in trees)
        scale, shift, yh = 1.0, 0.0, y[held]
        for _ in range(300):  # Platt scaling
            q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
            scale -= 0.05 * (((q - yh) * z).mean() + 1e-3 * scale)
            shift -= 0.05 * (q - yh).mean()
        q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        kinds, thresholds = x[held][:, 0], []
        for k in range(len(KINDS)):
            p, t = q[kinds == k], yh[kinds == k]
            steps = [c for c in sorted(set(np.round(p, 4))) if (p >= c).any() and t[p >= c].mean() >= PRECISION]
            thresholds.append(float(min(max(steps[0] if steps else 0.99, 0.5), 0.99)))
        _models[key] = Model(trees, scale, shift, thresholds)
    return _models[key]


# ---------------------------------------------------------------- candidates and findings


def candidates(text: Column, kind: int) -> Column:
    """All matches of a kind's pattern: array of (s, kind, e, m, before, after)."""
    pattern = F.lit(PATTERNS[kind])
    m = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)

    def build(both: Column) -> Column:
        found, between = both["m"], both["g"]
        lead: Column = F.transform(found, lambda x, i: (F.length(F.get(between, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))).cast("long"))

        def placed(start):
            return F.transform(
                found,
                lambda x, i: F.struct(
                    F.get(start, i).alias("s"), F.lit(kind).alias("kind"), (F.get(start, i) + F.length(x)).alias("e"), x.alias("m"), F.right(F.get(between, i), F.lit(BEFORE)).alias("before"), F.left(F.get(between, i + 1), F.lit(AFTER)).alias("after")
                ),
            )

        return _bind(lead, lambda g: _bind(_running(g), placed))

    none = F.array().cast("array<struct<s:bigint,kind:int,e:bigint,m:string,before:string,after:string>>")
    # bound once each by a lambda, so that neither pattern runs again for every use
    whole = F.flatten(F.transform(F.array(F.struct(m.alias("m"), gaps.alias("g"))), lambda b: F.when(F.size(b["m"]) > 0, build(b)).otherwise(none)))
    return whole if NEEDS[kind] is None else F.when(F.instr(text, NEEDS[kind]) > 0, whole).otherwise(none)


def _found(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: base findings and all findings, by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = "found_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    of = [f"{tag}{k}" for k in range(len(KINDS))]
    base, every = f"{tag}base", f"{tag}all"
    with_all = docs
    for k, name in enumerate(of):
        with_all = with_all.withColumn(name, candidates(text, k))

    def fitting(k):
        return F.filter(F.col(of[k]), lambda c: _fits(k, c["m"]))

    with_all = with_all.withColumn(base, F.concat(*map(fitting, range(BASE))))
    other = F.filter(F.concat(*(F.col(of[k]) for k in range(BASE, len(KINDS)))), lambda c: ~F.exists(F.col(base), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    # features are made once for each candidate, then the trees read them
    def kept(c):
        row = F.struct(*(f.alias(n) for f, n in zip(features(c), NAMES)))
        return F.exists(F.transform(F.array(row), lambda f: model.accepted(f)), lambda ok: ok)

    return with_all.withColumn(every, F.concat(F.col(base), F.filter(other, kept))), base, every


def _spans(found: Column) -> Column:
    order = F.array_sort(F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = model or trained(docs.sparkSession)
    found, base, every = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)

    def count(k):
        return F.size(F.filter(F.col(base), lambda c: c["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(count, range(BASE))
    return found.select("doc_id", *counts, F.sha2(_spans(F.col(base)), 256).alias("base_sha256"), _spans(F.col(every)).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each finding in text replaced by its kind in brackets; null texts stay null."""
    model = model or trained(docs.sparkSession)
    found, _, every = _found(docs, model)
    order = F.array_sort(F.transform(F.col(every), lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    # overlapping findings are masked from the first one's start; a later one masks what is left of it
    done = F.aggregate(
        order,
        start,
        lambda a, c: F.when(c["e"] <= a["at"], a).otherwise(
            F.struct(c["e"].alias("at"), F.concat(a["out"], F.array(F.substring("text", (a["at"] + 1).cast("int"), F.greatest(c["s"] - a["at"], F.lit(0)).cast("int")), F.concat(F.lit("["), F.upper(F.element_at(names, c["kind"] + 1)), F.lit("]")))).alias("out"))
        ),
    )
    new = F.concat(F.array_join(done["out"], ""), F.substring("text", (done["at"] + 1).cast("int"), F.lit(2147483647)))
    return found.withColumn("text", F.when(F.size(F.col(every)) > 0, new).otherwise(F.col("text"))).select(*docs.columns)
