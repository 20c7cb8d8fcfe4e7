"""Fill-in-middle, suffix-array removal and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import fill_middle, periodic_runs
from tessera.llm.queries import QUERIES

DOCS = "doc_id long, text string"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(r))


# ------------------------------------------------------------------ fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(units), hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, p, m = "plain", text, None, None
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    size = lambda x: None if x is None else len(x)
    return {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": size(p), "middle_chars": size(m), "output_sha256": sha(out), "restored_sha256": sha(text)}


ODD = ["", None, "a", " ", "ab cd", "x<P>y", "<S", "a<", "<<S>", "P>x<S<M", "\n\n a\r\nb", "😀😀a😀b", "é́ab c", "日本語 text 中文", "\x00a\x00", "a1b22c", "<P", "e\U00010400f", "-" * 50, "word " * 3000]


def test_fill_middle_equals_brute_force(spark):
    rows = [(k, t) for k in (*range(60), None) for t in ODD]
    assert got(fill_middle.digest(spark.createDataFrame(rows, DOCS))) == sorted((brute_fim(*r) for r in rows), key=repr)


def test_fill_middle_sql_agrees(spark):
    import pandas as pd

    rows = [(k, t.replace("\x00", "") if t else t) for k in range(40) for t in ODD]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    sql = con.execute(fill_middle.ORACLE).fetch_df().astype(object)
    want = sorted(({k: None if v is None or v != v else v for k, v in r.items()} for r in sql.to_dict("records")), key=repr)
    assert got(fill_middle.digest(spark.createDataFrame(rows, DOCS))) == want


@pytest.mark.parametrize(
    "units, pattern",
    [(fill_middle.WORDS, r"[A-Za-z]+|[^A-Za-z]"), (fill_middle.CHARACTERS, r"[\s\S]"), (fill_middle.LINES, r"[^\n]*\n|[^\n]+"), (fill_middle.MIXED, r"[A-Za-z]+|[0-9]+|[ \t\n\r\f\x0B]+|[\s\S]")],
)
def test_grammars_split_as_their_patterns_match(spark, units, pattern):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], DOCS)
    from pyspark.sql import functions as F

    for r in df.select("text", fill_middle.pieces(F.coalesce("text", F.lit("")), units).alias("p")).collect():
        assert r.p == re.findall(pattern, r.text or "")


def test_fill_middle_keeps_rows_columns_and_the_jvm(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c d", "x", "y"), (1, "a b c d", "x", "y")], "doc_id long, text string, _pieces string, fim string")
    out = fill_middle.transform(df)
    assert out.columns == df.columns and [r._pieces for r in out.collect()] == ["x", "x"]
    back = out.select("text", fill_middle.restore(F.col("fim.output"), F.col("fim.form")).alias("r")).collect()
    assert all(r.text == r.r for r in back)
    assert fill_middle.digest(df.limit(0)).collect() == []
    plan = fill_middle.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# ------------------------------------------------------------------ periodic runs


def brute_runs(x):
    """Every maximal stretch of every period, smallest periods alone, by definition."""
    n, out = len(x), []
    for q in range(1, n):
        start = 0
        while start + q < n:
            if x[start] != x[start + q] or start and x[start - 1] == x[start - 1 + q]:
                start += 1
                continue
            end = start + q
            while end < n and x[end] == x[end - q]:
                end += 1
            s = x[start:end]
            if len(s) >= max(24, 3 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((start, end - start, q))
            start += 1
    return sorted((s, m, q) for s, m, q in out)


def brute_periods(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def repetitive(r, size):
    """Random stretches of small alphabets, repeated blocks, and blocks of blocks."""
    out = []
    while len(out) < size:
        block = [r.choice("abc") for _ in range(r.randint(1, 12))]
        out += block * r.choice([1, 1, 2, 5, 9]) + [r.choice("abcdefgh") for _ in range(r.randint(0, 5))]
        if r.random() < 0.2:
            out += out[-r.randint(1, len(out)) :] * r.randint(1, 3)
    return out[:size]


def test_runs_equal_brute_force():
    r = random.Random(5)
    for k in range(250):
        x = repetitive(r, r.choice([5, 23, 24, 30, 70, 150]))
        ids = periodic_runs.numbered([w.encode() for w in x])
        want = brute_runs(x)
        for most in (1, 50, 1 << 20):
            assert [tuple(v) for v in periodic_runs.find(ids, most_pairs=most).tolist()] == want


@pytest.mark.parametrize("base", [1, 1 << 63, 0])
def test_runs_survive_useless_hashes(base):
    """With a multiplier under which most stretches look alike, verification still gives the truth."""
    r = random.Random(8)
    for _ in range(40):
        x = repetitive(r, 60)
        assert [tuple(v) for v in periodic_runs.find(periodic_runs.numbered([w.encode() for w in x]), base).tolist()] == brute_runs(x)


def test_runs_of_special_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for x in (list(fib[-1]), [str(v) for v in thue], ["a"] * 100, ["a"] * 23, ["a", "b"] * 12):
        assert [tuple(v) for v in periodic_runs.find(periodic_runs.numbered([w.encode() for w in x])).tolist()] == brute_runs(x)
    long = np.zeros(200_000, np.int64)
    assert periodic_runs.find(long).tolist() == [[0, 200_000, 1]]


def test_periods_equal_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(repetitive(r, r.choice([0, 1, 10, 40, 120]))) for _ in range(80)] + ["", None, " \t\n", "x" * 5000, "é b " * 30, "\x1ca\x85b " * 40, "a\x0bb\x0cc\r\n" * 20]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 20), (7, texts[7])]
    assert got(periodic_runs.digest(spark.createDataFrame(rows, DOCS))) == sorted((brute_periods(*x) for x in rows), key=repr)
    assert periodic_runs.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_and_collapse_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "x y z " * 10, "s"), (2, None, None), (3, "one  two", "t")], "doc_id long, text string, start string")
    assert [tuple(x) for x in periodic_runs.runs_of(df).collect()] == [(1, 0, 30, 3)]
    assert [tuple(x) for x in periodic_runs.collapse(df).collect()] == [(1, "x y z", "s"), (2, None, None), (3, "one  two", "t")]


@pytest.mark.parametrize("name, brute", [("op11_fill_middle", brute_fim), ("op13_periodic_runs", brute_periods)])
def test_queries_on_a_fixture(spark, tmp_path, name, brute):
    r = random.Random(1)
    rows = [(k, " ".join(repetitive(r, 60))) for k in range(30)] + [(5, None), (6, "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(QUERIES[name](spark, str(tmp_path))) == sorted((brute(*x) for x in rows), key=repr)


@pytest.mark.parametrize("name", ["op5_decontaminate", "op6_url_filter", "op7_vector_dup", "op11_fill_middle"])
def test_queries_against_their_sql(spark, name):
    from tessera.llm.queries import ORACLES
    from tests.test_oracle import DIR, TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = rows(con.execute(ORACLES[name]).fetch_df())
    found = QUERIES[name](spark, DIR).toPandas()
    assert rows(found[[c for c in found.columns if c in want[0]]]) == want and len(want[1]) >= 50
    assert set(found.columns) == set(want[0])


# ------------------------------------------------------------------ suffix-array removal


def brute_removal(texts, length=200):
    """By a dictionary of every string of the length."""
    from collections import Counter

    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len([m for m in re.finditer(b"\1+", bytes(gone))])
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def passages(r, many):
    """Texts with copies, shared passages around the limit, repeats inside, boilerplate and edits."""
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(400)[: r.choice([150, 198, 199, 200, 201, 230, 500])] for _ in range(8)]
    boiler = prose(100)[:170]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, boiler, "é" * 150]
    for _ in range(many):
        kind, base = r.random(), prose(r.randint(1, 120))
        if kind < 0.3:
            at = r.randint(0, len(base))
            base = base[:at] + r.choice(shared) + base[at:]
        elif kind < 0.4:
            base = base + base[-r.randint(1, len(base)) :]
        elif kind < 0.6 and texts[-1]:
            old = texts[-1]
            at = r.randint(0, len(old))
            base = old[:at] + r.choice(["", "Q", "new words "]) + old[at + r.choice([0, 1]) :]
        elif kind < 0.7:
            base = r.choice(texts)
        elif kind < 0.9:
            base = base + " " + boiler + " " + prose(20)
        texts.append(base)
    return texts


@pytest.mark.parametrize("wide, piece, block, seed", [(2000, 1 << 20, 10_000, 1), (1, 1 << 20, 1, 2), (5, 256, 50, 3), (2000, 150, 1, 4)])
def test_removal_equals_brute_force(spark, wide, piece, block, seed):
    """Also with grams that count as wide, pieces that cut texts, and one-row blocks of stretches."""
    from tessera.llm import suffix_dedup

    texts = passages(random.Random(seed), 150)
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got_ = sorted((tuple(x) for x in suffix_dedup.digest(df, suffix_dedup.Sizes(piece, wide, block)).collect()), key=repr)
    assert got_ == sorted(((i, *x) for (i, _), x in zip(rows, brute_removal(texts), strict=True)), key=repr)
    assert sum(x[2] for x in got_) > 1000


def test_removal_query(spark, tmp_path):
    texts = passages(random.Random(6), 200)
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got_ = sorted(tuple(x) for x in QUERIES["op12_suffix_dedup"](spark, str(tmp_path)).collect())
    assert got_ == [(k, *x) for k, x in enumerate(brute_removal(texts))]


def test_removal_with_one_hot_text_and_one_hot_passage(spark):
    """A third of the rows are one text, a third hold one passage; many buckets, equal keys at borders."""
    from tessera.llm import suffix_dedup

    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    hot, passage = prose(90), prose(60)[:260]
    texts = [hot] * 100 + [f"{prose(30)} {passage} {prose(30)}" for _ in range(100)] + [prose(60) for _ in range(100)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        got_ = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [got_[k] for k in range(300)] == brute_removal(texts)


def test_removal_keeps_other_columns(spark):
    from tessera.llm import suffix_dedup

    t = "".join(random.Random(3).choice("abc é") for _ in range(400))
    df = spark.createDataFrame([(1, t, "a"), (2, "left " + t, "b"), (3, None, "c"), (4, "short", "d")], "k1 long, text string, ats string")
    assert sorted(tuple(x) for x in suffix_dedup.remove(df).collect()) == [(1, "", "a"), (2, "left ", "b"), (3, None, "c"), (4, "short", "d")]
    assert suffix_dedup.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_multikey_order():
    from tessera.llm import suffix_dedup

    r = np.random.default_rng(1)
    keys = r.integers(0, 4, (500, 5))
    order, same = suffix_dedup.multikey(500, 5, lambda k, which: keys[which, k])
    rows = [tuple(keys[i]) for i in order.tolist()]
    assert rows == sorted(map(tuple, keys.tolist())) and same.tolist() == [False, *(a == b for a, b in zip(rows, rows[1:]))]
