"""Corpus operators against brute force, libraries and edge cases on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, graph, language_model, near_dup, pii, secrets, token_files, toxicity, url_filter, vector_dup

TIKTOKEN, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = [f"w{k}" for k in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [None, "", " ", "a", "a", "\n\t\x00", "é😀 ΑΒΓ", "x" * 3000, prose(1, 5000)]


def noise(n, alphabet, length=40, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, length))) for _ in range(n)]


# ---------------------------------------------------------------- 1, and graphs


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jp(a, b):
    x, y = Counter(a), Counter(b)
    out = 0.0
    for i in set(x) & set(y):
        out += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y))
    return out


def test_signature_estimates_probability_jaccard():
    r = random.Random(0)
    a = [r.randint(0, 200) for _ in range(400)]
    b = a[:330] + [r.randint(300, 400) for _ in range(70)]
    to = lambda v: (np.array(sorted(set(v)), np.uint64), np.array([Counter(v)[k] for k in sorted(set(v))]))
    (ea, wa), (eb, wb) = to(a), to(b)
    sa, sb = near_dup.signature(near_dup.mix(ea), wa, 2000), near_dup.signature(near_dup.mix(eb), wb, 2000)
    assert abs((sa == sb).mean() - jp(a, b)) < 0.04
    plain = len(set(a) & set(b)) / len(set(a) | set(b))
    assert near_dup.similarity(ea, wa, eb, wb) == pytest.approx(max(plain, jp(a, b)))


def test_near_duplicates_by_brute_force(spark):
    base = [prose(k, 120) for k in range(6)]
    texts = list(EDGES)
    for k, b in enumerate(base):
        w = b.split()
        texts += [b, b, b.upper()] + [" ".join(w[:j] + ["new"] + w[j + 1 :]) for j in (3, 60, 117)] + [" ".join(w[:60] + prose(90 + k, 60).split())]
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, texts)).collect()}
    s = [near_dup.shingles((t or "").encode()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[i] == texts[j] or near_dup.similarity(*s[i], *s[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert got == dict(enumerate(parent))
    kept = near_dup.deduplicate(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(parent))
    assert near_dup.classes(frame(spark, [])).count() == 0


def brute_force_classes(texts):
    s, parent = [near_dup.shingles(t.encode()) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if parent[i] != parent[j] and near_dup.similarity(*s[i], *s[j]) >= 0.8:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    return dict(enumerate(parent))


@pytest.mark.parametrize("block", [near_dup.BLOCK, 40])
def test_links_in_large_buckets_that_no_leader_meets(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    # 0.783 alike by one passage; two and two share three more words and are 0.802 alike
    passage, tails = prose(700, 220), [prose(800 + k, 30).split() for k in range(120)]
    for k in range(0, 60, 2):
        tails[k + 1][:3] = tails[k][:3]
    texts = [passage + " " + " ".join(t) for t in tails]
    want = brute_force_classes(texts)
    assert len(set(want.values())) == 90
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, texts)).collect()}
    assert got == want


def test_plain_jaccard_links_texts_that_differ_in_repetition(spark):
    many = [f"z{k}" for k in range(2000)]
    texts = []
    for k in range(4):
        words = random.Random(k).sample(many, 300)
        texts += [" ".join(words), " ".join(words + many[:10] * 60)]
    s = [near_dup.shingles(t.encode()) for t in texts]
    assert near_dup.similarity(*s[0], *s[1]) > 0.9 and near_dup.similarity(*s[0], *s[2]) < 0.1
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, texts)).collect()}
    assert got == {k: k // 2 * 2 for k in range(8)} == brute_force_classes(texts)


# ---------------------------------------------------------------- 2 and 9


def test_pack_round_trip():
    ids = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ids) + 1):
        control, data = token_files.pack(ids[:n])
        assert (token_files.unpack(control, data, n) == ids[:n]).all() and len(control) == -(-n // 4)


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = EDGES + noise(150, list("ab1 \n\t'.,  st'llé中😀!")) + ["a  b", " \n x"]
    tok = Tokenizer.from_file(JSON)
    got = sorted(token_files.digest(token_files.round_trip(frame(spark, texts), JSON)).collect())
    at = 0
    for r, t in zip(got, texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(frame(spark, []), JSON).count() == 0


def test_bpe(spark):
    import tiktoken

    vocab = bpe.vocabulary(TIKTOKEN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = [t or "" for t in EDGES] + noise(2000, list("ab1 \n\t'   st'llrevedmé中😀٣½!?.,-\x1c\x85")) + ["it's we'll I'd 'S", "'s", "x" * 97 + " y" * 50, "<|endoftext|>"]
    for t, (ids, chars, first) in zip(texts, vocab.encode(texts)):
        assert list(ids) == enc.encode_ordinary(t)
        assert vocab.decode(ids) == t.encode()
        for k in range(len(chars)):  # offsets: a piece's ids decode to its characters
            end, stop = (chars[k + 1], first[k + 1]) if k + 1 < len(chars) else (len(t), len(ids))
            assert vocab.decode(ids[first[k] : stop]).decode() == t[chars[k] : end]
    rows = bpe.digest(frame(spark, [None, "a b"]), TIKTOKEN).collect()
    assert [r.n_tokens for r in rows] == [0, 2] and rows[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert [bytes(r.bytes) for r in bpe.decode(bpe.encode(frame(spark, ["é'll"]), TIKTOKEN), TIKTOKEN).collect()] == ["é'll".encode()]


def test_scan_composes_transitions():
    f = np.array([[1, 0], [1, 0], [0, 1], [1, 0], [0, 0], [1, 0]], np.uint8)
    want, state = [], 0
    for row in f:
        state = row[state]
        want.append(state)
    assert bpe.scan(f).tolist() == want


# ---------------------------------------------------------------- 3 and 8


def test_secrets(spark):
    texts = EDGES + noise(300, ["password", "TOKEN", "=", ":", '"', " ", "AKIA", "A9Z", "0af1", "abcdef012345", ".", "x"], 16)
    kinds = [re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    net = secrets.train()
    assert net.threshold >= 0.5
    made = secrets.made_findings(600, seed=42)
    p = net.accepts([secrets.windows(t, s, e)[0] for t, s, e, _ in made])
    y = np.array([m[3] for m in made])
    assert (p[y == 1] >= net.threshold).mean() > 0.93 and (p[y == 0] >= net.threshold).mean() < 0.05
    for r in secrets.scan(frame(spark, texts), net).collect():
        t, want = texts[r.doc_id] or "", []
        for k, pat in enumerate(kinds):
            for m in pat.finditer(t):
                if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                    want.append((m.start(), k, m.end()))
        told = secrets.told(sorted(want))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
    clean = secrets.redact(frame(spark, [None, "a password=hunter22 b"]), net).collect()
    assert [(r.text, r.n_chars) for r in clean] == [(None, None), ("a [SECRET] b", 12)]


def luhn(m):
    d = [int(c) for c in m if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    texts = EDGES + noise(400, list("ab@@..%+-- 0123456789()é😀\n+")) + noise(400, list("0123456789 -.+"), 60) + ["a@b.c@d.e x", "..foo@bar..baz@x.y", "a@b.c_x@d.e", "1.2.3.400.5.6.7", "+1 (269) 555-3296 4524132264652876", "a.b@c.de " * 300]
    base = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fits(k, s):
        n = sum(c.isdigit() for c in s)
        return (True, k == 1 and all(int(x) <= 255 for x in s.split(".")), 14 <= n <= 19 and luhn(s), 10 <= n <= 15)[k]

    for r in pii.find(frame(spark, texts)).collect():
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(base) for m in re.finditer(p, texts[r.doc_id] or "") if fits(k, m[0]))
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, [None, "mail a@b.cd now", "phone: 555-123-4567.", "order 555-12-4567"])).collect()}
    assert got == {0: None, 1: "mail [EMAIL] now", 2: "phone: [NATIONAL].", 3: "order 555-12-4567"}


def test_pii_plan_is_native(spark):
    plan = pii.find(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 4


def lm_tokens(t):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w.encode() for w in re.findall("[^\x20\x09-\x0D]+", lower)] + [b""]


def test_split_of_a_part():
    texts = [*noise(300, "aB É\t\x0b\x1c\x85\u3000 ñ", 200), None, ""]
    part = language_model.pa.array(texts).slice(37, 260)
    words, at, ends = language_model.split(part)
    words = words.to_pylist()
    assert [[words[k] for k in a] for a in np.split(at, ends[:-1])] == [lm_tokens(t) for t in part.to_pylist()]


def test_language_model(spark):
    texts = [prose(k, 80) for k in range(60)] + EDGES + noise(60, "aB É\t\x0b\x1c\x85\u3000 ") + ["  lead", "trail \n"]
    rows = language_model.score(frame(spark, texts)).collect()
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = lm_tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(w), sum(counts[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(frame(spark, [])).count() == 0


def test_network_beats_counts_by_word_order(spark):
    """Where a word tells the next, held-out documents are likelier than by counts, a tenth of a decade a token."""
    import random

    r = random.Random(4)

    def chain(n):
        out = [r.randrange(40)]
        for _ in range(n):
            out.append((out[-1] * 7 + 3) % 40 if r.random() < 0.8 else r.randrange(40))
        return " ".join(f"w{k}" for k in out)

    rows = language_model.score(frame(spark, [chain(60) for _ in range(3000)]).coalesce(1)).where("held_out").collect()
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows) + 0.1 * sum(x.n_tokens for x in rows)


def test_buckets_of_words_not_known_cost_no_python_a_word(monkeypatch):
    """Words not known are looked up together: Python is run for pairs of last characters, not for words."""
    known = {f"k{i}".encode(): 3000 - i for i in range(language_model.WORDS + 50)}
    places = language_model.Places(language_model.Statistics(5000, 80, known, np.full(language_model.BUCKETS, 2.0), np.full(language_model.BUCKETS, 1.0)))
    words = [f"{i}{end}" for i in range(2000) for end in ("ing", "ñé", "")] + ["k3", "é", "x", "", f"k{language_model.WORDS + 7}"]
    calls, bucket = [], language_model.bucket
    monkeypatch.setattr(language_model, "bucket", lambda w: calls.append(w) or bucket(w))
    output = places.output[places.of(language_model.pa.array(words, language_model.pa.large_string()))]
    assert output.tolist() == [3 if w == "k3" else language_model.WORDS + bucket(w.encode()) for w in words]
    assert len(calls) <= len({w[-2:] for w in words})


def test_sums_of_runs():
    g = np.random.default_rng(5)
    for sizes in ([1], [300], [1, 1, 1], [23, 24, 25, 1, 2, 700], g.integers(1, 40, 60)):
        rows = g.normal(size=(sum(sizes), 6)).astype(np.float32)
        begins = np.append(0, np.cumsum(sizes))[:-1]
        want = [rows[a : a + n].sum(0) for a, n in zip(begins, sizes)]
        assert language_model.run_sums(rows, begins) == pytest.approx(np.array(want), abs=1e-4)


def test_network_against_plain_steps():
    """Scores are those of the recurrence written down a step at a time."""
    known = {f"k{i}".encode(): 3000 - i for i in range(language_model.WORDS)}
    net = language_model.Network(language_model.Statistics(5000, 80, known, np.full(language_model.BUCKETS, 2.0), np.full(language_model.BUCKETS, 1.0)))
    g, s, per = np.random.default_rng(2), language_model.STATE, language_model.PER_CLASS
    net.p = {k: g.normal(0, 0.4, v.shape).astype(np.float32) for k, v in net.p.items()}
    table, u, wc, ww = (net.p[k].astype(float) for k in net.NAMES)

    def plain(doc):
        h, x, total = np.zeros(s), language_model.START, 0.0
        for y in doc:
            a, b = table[x], h @ u
            z, r = (1 / (1 + np.exp(-(a + b)[k * s : k * s + s])) for k in (0, 1))
            n = np.tanh(a[2 * s :] + r * b[2 * s :])
            h = (1 - z) * n + z * h
            e, own = np.append(h, 1), y < language_model.WORDS
            c = y // per if own else y - language_model.WORDS + language_model.CLASSES
            total += (e @ wc)[c] - np.log(np.exp(e @ wc).sum())
            if own:
                total += (e @ ww[c])[y % per] - np.log(np.exp(e @ ww[c]).sum())
            x = y
        return total / np.log(10)

    docs = [g.integers(0, language_model.START, n) for n in (70, 1, 33, 32)]
    assert net.score(docs) == pytest.approx([plain(d) for d in docs], rel=1e-4)


def test_network_learns_from_every_training_document(spark, monkeypatch):
    # a rate without the optimiser's memory shows each document's own share
    texts = [prose(k, 20) for k in range(60)]
    docs = frame(spark, texts).coalesce(1)
    stats = language_model.statistics(language_model.word_counts(docs))
    before = language_model.train(docs, stats).flat()
    for k in (0, 7, 23, 41, 59):
        turned = [" ".join(reversed(t.split())) if i == k else t for i, t in enumerate(texts)]
        after = language_model.train(frame(spark, turned).coalesce(1), stats).flat()
        assert np.abs(before - after).max() > 1e-5


def test_gradients_by_differences():
    """The loss that one step of learning sees, by finite differences of its weights."""
    known = {f"k{i}".encode(): 300 - i for i in range(language_model.WORDS)}
    stats = language_model.Statistics(5000, 80, known, np.full(language_model.BUCKETS, 2.0), np.full(language_model.BUCKETS, 1.0))
    net = language_model.Network(stats)
    g = np.random.default_rng(1)
    net.p = {k: g.normal(0, 0.4, v.shape) for k, v in net.p.items()}
    docs = [g.integers(0, language_model.START, n) for n in (20, 9, 5)]

    def loss():
        return -sum(net.score(docs)) * np.log(10)

    seen = {}
    keep = {k: v.copy() for k, v in net.p.items()}
    net.start_learning()
    net.m = type("Spy", (dict,), {"__setitem__": lambda d, k, v: (seen.__setitem__(k, v), dict.__setitem__(d, k, v))})(net.m)
    n = net.learn(docs, 0.0)
    assert n == 34
    ratios = []
    for k, v in keep.items():
        net.p = {q: w.copy() for q, w in keep.items()}
        flat = net.p[k].reshape(-1)
        for at in np.argsort(-np.abs(seen[k].ravel()))[:4]:
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            ratios.append((up - down) / 2e-3 / (seen[k].ravel()[at] * 10))
    assert np.ptp(ratios) < 0.05 * abs(np.mean(ratios)) and np.mean(ratios) > 0  # the clip scales all alike


def test_state_is_carried_and_outputs_sum_to_one():
    known = {f"k{i}".encode(): 100 - i for i in range(50)}
    stats = language_model.Statistics(5000, 80, known, np.full(language_model.BUCKETS, 2.0), np.full(language_model.BUCKETS, 1.0))
    net = language_model.Network(stats)
    g = np.random.default_rng(0)
    docs = [g.integers(0, 50, n) for n in (100, 3, 33, 1)]
    before = net.score(docs)
    for _ in range(3):
        net.learn(docs, 0.01)
    assert net.score(docs).sum() > before.sum()
    together, alone = net.score(docs), [net.score([d])[0] for d in docs]  # lanes and windows change nothing
    assert together == pytest.approx(alone, rel=1e-4)
    h = np.append(g.normal(size=(1, language_model.STATE)), [[1]], 1).astype(np.float32)
    every = np.arange(language_model.WORDS + language_model.BUCKETS)
    assert np.exp(net.outputs(np.repeat(h, len(every), 0), every)[0]).sum() == pytest.approx(1, rel=1e-4)


# ---------------------------------------------------------------- 5


def test_decontamination(spark):
    items = [prose(500, 30), prose(501, 30), "Tiny item", "", None, prose(500, 30), "w1"[:0] + prose(502, 10)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    w = items[0].split()
    texts = EDGES + [prose(7, 50) + " " + " ".join(w[5:16]) + " " + prose(8, 9), " ".join(w[:9]), "a TINY, item!", items[1] + " " + items[1], items[6].upper(), " ".join(w[2:12])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for block_bytes in (1 << 20, 64):  # one block, and one for each item or so
        for r in decontaminate.judge(frame(spark, texts), bench, block_bytes=block_bytes).collect():
            d, hit, found = word.findall(low(texts[r.doc_id])), set(), set()
            for i, t in enumerate(items):
                v = word.findall(low(t))
                for k in range(max(1, len(v) - 9)) if v else ():
                    win = v[k : k + 10]
                    for at in range(len(d) - len(win) + 1):
                        if d[at : at + len(win)] == win:
                            hit |= set(range(at, at + len(win)))
                            found.add(str(i))
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(d), len(hit), len(found), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    left = decontaminate.decontaminate(frame(spark, texts), bench)
    assert left.columns == frame(spark, []).columns and left.count() == len(EDGES) + 1
    assert decontaminate.judge(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_longest_matches():
    tests = decontaminate.Tests([("i", b"a b c d e")], window=3)
    codes = np.array([tests.vocab.get(x, 0) for x in [b"x", b"b", b"c", b"d", b"x", b"a"]])
    assert decontaminate.matches(codes, tests)[0].tolist() == [1, 3, 2, 1, 0]


# ---------------------------------------------------------------- 6 and 7


def test_urls(spark):
    rows = [(1, "https://a.com/en/1", '<link rel="canonical" href="https://b.io/x#f">'), (2, "http://b.io/x", None), (3, "http://c.io/y", "<LINK href=/z rel=canonical>"), (4, "http://C.io/z", '<meta http-equiv=refresh content="0; url=https://shop.example.com/en/77">'), (5, None, "x"), (6, "nope", "y"), (7, "http://d.io/q?a=1", '<link rel="canonical" href="https://b.io/x">'), (8, "http://x.example.net/de/81", ""), (8, "http://example.net/de/7", None)]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "a.com", "/en/1", "com/en/", "block"), (2, "b.io", "/x", None, "block"), (3, "c.io", "/y", None, "allow"), (4, "c.io", "/z", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "d.io", "/q", None, "block"), (8, "x.example.net", "/de/81", "example.net/de/8", "block"), (8, "example.net", "/de/7", "net/de/", "allow")], key=str)
    moved = spark.createDataFrame([("http://b.io/x", "http://y.example.com/en/7")], "from_url string, to_url string")
    assert url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=moved).where("page_id = 2").first().verdict == "allow"


def test_vectors(spark, monkeypatch):
    g = np.random.default_rng(1)
    base = g.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + g.normal(size=(20, 16)) * 0.08, base[:10] + g.normal(size=(10, 16)) * 0.3, base[:5]])
    label = [k % 3 for k in range(40)] + [k % 3 for k in range(20)] + [k % 3 for k in range(10)] + [k % 3 for k in range(5)]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [None] * 16, 1), (93, [float("nan")] * 16, 1), (94, x[0].tolist(), None), (95, [1.0], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(x))])
    for per_cell, size in ((16384, 1024), (20, 8)):
        monkeypatch.setattr(vector_dup, "PER_CELL", per_cell)
        monkeypatch.setattr(vector_dup, "BLOCK", size)
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert {i: got[i] for i in range(len(x))} == {i: (near[i].sum(), comp[i]) for i in range(len(x))}
        assert all(got[k] == (0, k) for k in range(90, 96))


# ---------------------------------------------------------------- 10


def test_toxicity(spark):
    insults = ["grumblefool", "snortwit", "blatherskite", "numbskull"]
    texts, marks = [], []
    for k in range(400):
        w, bad = prose(1000 + k, 40).split(), k % 4 == 0
        if bad:
            w[7], w[20] = insults[k // 4 % 4], insults[k // 8 % 4].upper() + "!!"
        texts.append(" ".join(w))
        marks.append((k, int(bad)))
    docs, labels = frame(spark, texts), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fold=toxicity.held_out())
    got = toxicity.score(docs, model).where(toxicity.held_out()).collect()
    right = sum((r.toxic_score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in got)
    assert right / len(got) > 0.95
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 270 <= kept.count() <= 310
    edge = {r.doc_id: r.toxic_score for r in toxicity.score(frame(spark, EDGES), model).collect()}
    assert edge[0] == edge[1] and all(0 <= s <= 1 for s in edge.values())
    assert toxicity.fit(docs, labels.limit(0)).constant == 0.0
