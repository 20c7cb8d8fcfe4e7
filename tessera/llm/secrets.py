"""Secret scans: base patterns, and a character convolutional network over every candidate.

Candidates are the base findings and all long mixed runs of token characters. Each is seen with its
surroundings (``BEFORE`` and ``AFTER`` characters) by a small convolutional network in numpy: learnt
character vectors, one layer of filters, maxima over the candidate and over its context, a logistic
output. It is trained on labelled findings; scores are calibrated on held-out ones and the
threshold is the highest that keeps the recall asked for. Base findings stay whatever it says;
accepted candidates that reach beyond them are added as kind "model".

Edge cases: null and empty texts have no findings; long candidates are scored in windows over
their whole length; repeated rows are scanned row by row; extra columns are kept by redact() and
ignored by scan(); offsets count code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, texts

KINDS = ["assign", "access", "hex", "model"]
#: Base patterns (fixed values); a match counts if what is tested has so many characters.
ASSIGN = re.compile(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are matched whole, so shorter ones need no match
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: A candidate: a run of token characters with a letter and a digit.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
BEFORE, BODY, AFTER = 24, 40, 8
RECALL = 0.98
#: Labelled findings that are made for training (half secrets), besides any that are given.
MADE = 4000

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The base findings of a text, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group().rstrip(".")
        if len(run) >= 16 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            out.append((m.start(), m.start() + len(run)))
    return out


_CODES = np.full(128, 2, np.int64)  # 0: no character, 1: not ASCII, 2: other ASCII
for _k, _c in enumerate(string.ascii_letters + string.digits + " .,:;=+-_/\"'@<>(){}[]#&?!%$*\n", 3):
    _CODES[ord(_c)] = _k
ALPHABET = int(_CODES.max()) + 1


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of a candidate and its surroundings, one row for each stretch of the candidate."""
    rows = []
    for at in range(start, end, BODY):
        stop = min(at + BODY, end)
        before = text[max(0, start - BEFORE) : start] if at == start else text[at - BEFORE : at]
        after = text[end : end + AFTER] if stop == end else text[stop : stop + AFTER]
        row = np.zeros(BEFORE + BODY + AFTER, np.int64)
        for part, place in ((before, BEFORE - len(before)), (text[at:stop], BEFORE), (after, BEFORE + BODY)):
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            row[place : place + len(code)] = np.where(code < 128, _CODES[np.minimum(code, 127)], 1)
        rows.append(row)
    return rows


class Network:
    """Character vectors, one convolution, maxima over body and context, logistic output."""

    def __init__(self, seed: int = 0, size: int = 8, width: int = 5, filters: int = 24):
        g = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {"emb": g.normal(0, 0.5, (ALPHABET, size)), "conv": g.normal(0, (2 / (width * size)) ** 0.5, (width * size, filters)), "bias": np.zeros(filters), "out": g.normal(0, 0.1, 3 * filters), "one": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        n = BEFORE + BODY + AFTER - width + 1
        place = np.arange(n) + width // 2
        body = (place >= BEFORE) & (place < BEFORE + BODY)
        self.zones = [np.flatnonzero(place < BEFORE), np.flatnonzero(body), np.flatnonzero(~body & (place >= BEFORE))]

    def forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        n, length, size = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.width, 1).transpose(0, 1, 3, 2).reshape(n, length - self.width + 1, self.width * size)
        act = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        arg = [z[act[:, z].argmax(1)] for z in self.zones]
        pooled = np.hstack([np.take_along_axis(act, a[:, None], 1)[:, 0] for a in arg])
        return cols, act, arg, pooled, pooled @ self.p["out"] + self.p["one"]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = [self.forward(x[k : k + 512])[4] for k in range(0, len(x), 512)]
        return (np.concatenate(out) if out else np.zeros(0)) * self.scale + self.shift

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean logistic loss."""
        cols, act, arg, pooled, z = self.forward(x)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        grad = {"out": pooled.T @ d, "one": np.array([d.sum()])}
        dp = d[:, None] * self.p["out"] * (pooled > 0)
        dconv, demb = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["emb"])
        rows = np.repeat(np.arange(len(x))[:, None], self.filters, 1)
        size = self.p["emb"].shape[1]
        for k, a in enumerate(arg):
            part = dp[:, k * self.filters : (k + 1) * self.filters]
            picked = cols[rows, a]  # n, filters, width * size
            dconv += np.einsum("nfc,nf->cf", picked, part)
            back = part[:, :, None] * self.p["conv"].T[None]  # n, filters, width * size
            for w in range(self.width):
                np.add.at(demb, x[rows, a + w].ravel(), back[:, :, w * size : (w + 1) * size].reshape(-1, size))
        grad |= {"conv": dconv, "emb": demb, "bias": sum(dp[:, k * self.filters : (k + 1) * self.filters].sum(0) for k in range(3))}
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over batches of 64."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for at in range(0, len(x), 64):
                pick = order[at : at + 64]
                t += 1
                for k, d in self.step(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings; then the highest threshold with the recall asked for."""
        z = self.logit(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.05 * (((q - y) * z).mean() + 1e-3 * a)
            b -= 0.05 * (q - y).mean()
        self.scale, self.shift = a, b
        held = np.sort(1 / (1 + np.exp(-np.clip(self.logit(x[y == 1]), -30, 30))))
        self.threshold = float(held[int((1 - recall) * len(held))]) if len(held) else 0.5

    def accepts(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logit(np.stack(rows)), -30, 30)))


def made_findings(n: int = MADE, seed: int = 1) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label) over varied prose, credentials and look-alikes."""
    r = random.Random(seed)
    letters, digits, hexa = string.ascii_letters, string.digits, "0123456789abcdef"
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    syllables = [pick("bcdfghklmnprstvwz", 1) + pick("aeiouéäñ", 1) + pick("nrstl", r.randint(0, 1)) for _ in range(120)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 7)))
    secret_forms = [
        (lambda: pick(letters + digits, r.randint(20, 44)), ["auth_key: ", "bearer ", "Authorization: Bearer ", "credential=", "pwd=", "private_key = \"", "client_key: '", ""]),
        (lambda: pick(letters + digits + "+/", r.randint(28, 60)) + r.choice(["", "=", "=="]), ["key=", "access key ", "signing key: ", "Basic ", ""]),
        (lambda: r.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "rk_test_", "glpat-", "SG.", "npm_"]) + pick(letters + digits, r.randint(20, 40)), ["", "use ", "export X="]),
        (lambda: "eyJ" + pick(letters + digits, 17) + ".eyJ" + pick(letters + digits, 24) + "." + pick(letters + digits + "_-", 30), ["", "jwt ", "cookie: "]),
        (lambda: pick(hexa, r.choice([32, 40, 64])), ["key ", "token = \"", "auth:", ""]),
        (lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), ["", "id "]),
    ]
    other_forms = [
        (lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", ["uuid ", "id=", ""]),
        (lambda: word() + "_" + word() + "_" + word() + "_" + pick(digits, r.randint(1, 4)), ["file ", "", "table "]),
        (lambda: "www." + word() + word() + ".example.com/" + word() + "/" + pick(digits, 3), ["https://", "http://", "see "]),
        (lambda: f"20{pick(digits, 2)}-{pick('01', 1)}{pick('12', 1)}-{pick('12', 1)}{pick(digits, 1)}-{word()}-{word()}", ["", "on "]),
        (lambda: word() + word() + word() + word() + word() + word()[:2] + pick(digits, 2), ["", "the "]),
        (lambda: word().encode("ascii", "ignore").decode() + "." + pick(digits, 2) + "=" + word() + word() + word(), ["", "p "]),
        (lambda: f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 2)}-{word()}-{word()}{pick(digits, 1)}", ["version ", ""]),
        (lambda: f"{word()}.{word()}{pick(digits, 1)}.{word()}.example.org", ["host ", "mail ", "@"]),
        (lambda: "-".join(word() for _ in range(5)) + pick(digits, 1), ["", "/"]),
        (lambda: f"{word()}/{word()}/{word()}{pick(digits, 2)}/{word()}.html", ["/", "path "]),
        (lambda: pick("abc", 1) * r.randint(14, 30) + pick(digits, 2), ["", "x"]),
        (lambda: word() + pick("0123456789", 14), ["isbn ", "no. ", "order "]),
    ]
    out = []
    for k in range(n):
        forms = secret_forms if k % 2 else other_forms
        make, leads = r.choice(forms)
        body = make().strip(".")
        head = prose() + r.choice([" ", ". ", "\n", ", "]) + r.choice(leads)
        out.append((head + body + r.choice([" ", ". ", "\" ", "' ", "\n", ", "]) + prose(), len(head), len(head) + len(body), k % 2))
    return out


def train(findings: list[tuple[str, int, int, int]] | None = None, recall: float = RECALL, seed: int = 0) -> Network:
    """Fit on labelled findings (text, start, end, label): those given and the made ones."""
    all_ = [*(findings or []), *made_findings()]
    x = np.stack([windows(t, s, e)[0] for t, s, e, _ in all_])
    y = np.array([label for *_, label in all_], float)
    held = np.random.default_rng(seed).random(len(x)) < 0.25
    net = Network(seed)
    net.fit(x[~held], y[~held], seed=seed)
    net.calibrate(x[held], y[held], recall)
    return net


def scan_batch(batch: list[str], net: Network) -> list[list[Span]]:
    """All spans of each text, by start, then kind.

    The network scores every candidate; one that lies within a base span and is accepted adds no
    span of its own, one that reaches beyond does.
    """
    spans, rows, owner = [], [], []
    for i, t in enumerate(batch):
        spans.append(base_spans(t))
        for s, e in candidates(t):
            for row in windows(t, s, e):
                rows.append(row)
                owner.append((i, s, e))
    best: dict = {}
    for o, p in zip(owner, net.accepts(rows)):
        best[o] = max(p, best.get(o, 0.0))
    reach: dict = {}  # of each text: starts of its base spans, and how far those so far reach
    for (i, s, e), p in best.items():
        if p >= net.threshold:
            if i not in reach:
                base = [b for b in spans[i] if b[1] < 3]
                reach[i] = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))
            starts, ends = reach[i]
            k = bisect.bisect_right(starts, s)
            if not k or ends[k - 1] < e:
                spans[i].append((s, 3, e))
    return [sorted(s) for s in spans]


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(net or train())

    def over(batch):
        found = scan_batch(texts(batch), held.value)
        base = [[s for s in f if s[1] < 3] for f in found]
        counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
        sha = [hashlib.sha256(told(b).encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([told(f) for f in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), over, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """text with each stretch of overlapping spans replaced by mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with secrets in text masked (n_chars, if there, as the new length); null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(net or train())

    def over(batch):
        raw = batch.column("text").to_pylist()
        found = scan_batch([t or "" for t in raw], held.value)
        new = [t if not f else masked(t, f) for t, f in zip(raw, found)]
        columns = dict(zip(batch.schema.names, batch.columns))
        columns["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in columns:
            was = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([len(t) if f else w for t, f, w in zip(new, found, was)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return arrow_map(docs, over, docs.schema)
