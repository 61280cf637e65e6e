"""Secret scans: exact base patterns, and a character convolutional network over every other candidate.

Base findings always stand.  Candidates are long runs of key-like characters, less what a base finding covers; the network
sees each with its surroundings and adds the ones that score at or above a threshold.  It is trained on labelled
findings: a bounded sample of the documents' own candidates, labelled by the base patterns, and made-up findings in
public key formats.  Candidates that may be keys themselves (a public format, or random letters) teach nothing.  The
threshold is the highest that still finds RECALL of the held-out positives and of those that no base pattern finds.
A candidate longer than the network's view is read in overlapping views; the highest score counts.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
#: About so many documents give labelled findings for training, at most so many of these, beside so many made-up ones.
SAMPLE_DOCS, SAMPLE_VIEWS, MADE_UP = 10_000, 6_000, 6_000
RECALL, SEED = 0.98, 7
LEFT, BODY, RIGHT = 20, 48, 8
WINDOW, DIM, WIDTH, FILTERS = LEFT + BODY + RIGHT, 10, 5, 32
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if _maybe_assign(text) else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))) if len(out) > 1 else out


def _maybe_assign(text: str) -> bool:
    low = text.lower()  # any letter that lower-cases to an ASCII one may only add work, not findings
    return any(k in low for k in ("passw", "secret", "token", "apikey", "api_key"))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Key-like runs with a digit, or with changing case.  Base findings part a run; each piece of SHORTEST characters counts."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for b, e in [*((b, e) for b, e, _ in taken if b < m.end() and e > m.start()), (m.end(), m.end())]:
            s = text[at:b] if b > at else ""
            if len(s) >= SHORTEST and (any(c.isdigit() for c in s) or not (s.islower() or s.isupper() or s[0].isupper() and s[1:].islower())):
                out.append((at, b))
            at = max(at, e)
    return out


def _views(text: str, start: int, end: int) -> list[str]:
    """Views of BODY characters and their surroundings that cover the candidate, each half over the one before."""
    ats = [start] if end - start <= BODY else [*range(start, end - BODY, BODY // 2), end - BODY]
    return [_view(text, at, min(at + BODY, end)) for at in ats]


def _view(text: str, start: int, end: int) -> str:
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + text[start:end].ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


#: Beginnings of public key formats, at the start of a word, with what must follow.
PUBLIC = re.compile(r"(?<![A-Za-z0-9])(?:gh[opsur]_|github_pat_|[rs]k_(?:live|test)_|sk-|xox[abeoprs]-|AIza|eyJ|glpat-|SG\.|npm_|AKIA|ASIA|hf_|pypi-)[A-Za-z0-9+/_.=-]{10,}")
RUN = re.compile(r"[A-Za-z0-9+]{16,}")


def may_be_key(s: str) -> bool:
    """Whether a candidate holds a public key format, or a run that changes between cases and digits as random letters do."""
    if PUBLIC.search(s):
        return True
    for m in RUN.finditer(s):
        kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in m.group()]
        changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / (len(kinds) - 1)
        if 0 in kinds and len(set(kinds)) > 1 and changes >= 0.25 or changes >= 0.4:
            return True
    return False


def encode(views: list[str]) -> np.ndarray:
    codes = np.array([[min(ord(c), 127) for c in v] for v in views], np.int64).reshape(-1, WINDOW)
    return codes


@dataclass
class Network:
    """Embedding, one convolution, rectifier, maxima over the surroundings and over the candidate, logistic output."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    threshold: float = 0.5
    scale: float = 1.0
    #: Of the held-out findings: shares of positives, of positives that no base pattern finds, and of negatives found.
    held: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        return Network(rng.normal(0, 0.3, (128, DIM)), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 3 * FILTERS), np.zeros(1))

    def _forward(self, codes: np.ndarray):
        e = self.emb[codes]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WINDOW - WIDTH + 1, WIDTH * DIM)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        zones = (h[:, : LEFT - 2], h[:, LEFT - 2 : LEFT + BODY - 2], h[:, LEFT - 2 : LEFT + BODY - 2])
        body = zones[1]
        live = (codes[:, LEFT : LEFT + BODY] > 0)[:, :, None]
        n = np.maximum(live.sum(axis=1), 1)
        f = np.concatenate([zones[0].max(axis=1), body.max(axis=1), (body * live).sum(axis=1) / n], axis=1)
        return f @ self.out + self.shift[0], f, h, cols, live, n

    def score(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        z = np.concatenate([self._forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])
        return 1 / (1 + np.exp(-np.clip(z * self.scale, -30, 30)))

    def _gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        z, f, h, cols, live, n = self._forward(codes)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        df = g[:, None] * self.out
        dh = np.zeros_like(h)
        rows, filt = np.arange(len(y))[:, None], np.arange(FILTERS)[None, :]
        dh[rows, h[:, : LEFT - 2].argmax(axis=1), filt] += df[:, :FILTERS]
        dh[rows, h[:, LEFT - 2 : LEFT + BODY - 2].argmax(axis=1) + LEFT - 2, filt] += df[:, FILTERS : 2 * FILTERS]
        dh[:, LEFT - 2 : LEFT + BODY - 2] += (df[:, 2 * FILTERS :] / n)[:, None, :] * live
        dh *= h > 0
        dcols = (dh @ self.conv.T).reshape(len(y), -1, WIDTH, DIM)
        demb, de = np.zeros_like(self.emb), np.zeros((len(y), WINDOW, DIM))
        for k in range(WIDTH):
            de[:, k : k + dcols.shape[1]] += dcols[:, :, k]
        np.add.at(demb, codes, de)
        return [demb, np.tensordot(cols, dh, ((0, 1), (0, 1))), dh.sum(axis=(0, 1)), f.T @ g, g.sum(keepdims=True)]

    def train(self, codes: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, rate: float = 0.01) -> None:
        parts = [self.emb, self.conv, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 128):
                own, t = order[at : at + 128], t + 1
                for k, g in enumerate(self._gradients(codes[own], y[own], balance[own])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    parts[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, owner: np.ndarray, y: np.ndarray, new: np.ndarray, recall: float) -> None:
        """Fits the slope of the scores, then takes the highest threshold with the recall asked for.

        codes: views, of the findings that owner numbers; y, new: of each finding, whether it is positive and whether no
        base pattern finds it.  A finding scores as its best view.
        """
        z = np.concatenate([self._forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, z)
        loss = lambda s: np.mean(np.logaddexp(0, -(2 * y - 1) * best * s))
        self.scale = min(np.geomspace(0.1, 4, 25), key=loss)
        score = np.full(len(y), -np.inf)
        np.maximum.at(score, owner, self.score(codes))
        groups = [np.sort(score[y > 0]), np.sort(score[(y > 0) & new])]
        self.threshold = min((float(g[int((1 - recall) * len(g))]) for g in groups if len(g)), default=0.5)
        share = lambda rows: float((score[rows] >= self.threshold).mean()) if rows.any() else 0.0
        self.held = share(y > 0), share((y > 0) & new), share(y == 0)


def made_up(rng: random.Random, words: list[str], n: int) -> list[tuple[str, int]]:
    """Views of made-up findings: public key formats (1) and harmless long strings (0), amid words."""
    return [(v, k) for views, k, _ in made_up_findings(rng, words, n) for v in views]


def made_up_findings(rng: random.Random, words: list[str], n: int) -> list[tuple[list[str], int, bool]]:
    """(views, label, whether no base pattern finds it)."""
    al, up, hx = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    take = lambda chars, lo, hi: "".join(rng.choices(chars, k=rng.randint(lo, hi)))
    word = lambda: rng.choice(words)
    secret = [
        lambda: "ghp_" + take(al, 36, 36), lambda: "github_pat_" + take(al + "_", 60, 82), lambda: "sk_live_" + take(al, 24, 32),
        lambda: "sk-" + take(al, 32, 48), lambda: "xoxb-" + take("0123456789", 11, 12) + "-" + take(al, 24, 24), lambda: "AIza" + take(al + "_-", 35, 35),
        lambda: "eyJ" + take(al + "_-", 20, 60) + "." + take(al + "_-", 30, 80) + "." + take(al + "_-", 30, 43), lambda: "glpat-" + take(al + "_-", 20, 20),
        lambda: take(al + "+/", 40, 40), lambda: take(al + "+/", 30, 64) + rng.choice(["=", "==", ""]), lambda: "SG." + take(al, 22, 22) + "." + take(al, 43, 43),
        lambda: "AKIA" + take(up, 16, 16), lambda: take(hx, 32, 64), lambda: "npm_" + take(al, 36, 36),
    ]
    harmless = [
        lambda: take("0123456789", 16, 19), lambda: f"{word()}.{rng.randint(1, 99)}-{word()}.example.com", lambda: "-".join(word() for _ in range(4)),
        lambda: "/".join([word(), word(), word(), f"{rng.randint(1, 9999)}.html"]), lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}",
        lambda: f"version-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-{word()}", lambda: "_".join([word(), word(), word(), str(rng.randint(1, 999))]),
        lambda: (word() + word() + word()).upper() + ".", lambda: "".join(word().capitalize() for _ in range(4)), lambda: "=" * rng.randint(16, 40), lambda: "-" * rng.randint(16, 60),
        lambda: word() + word() + word() + word() + ".", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(5)), lambda: word() + "." * rng.randint(12, 20),
    ]
    out = []
    for k in range(n):
        body = rng.choice(secret if k % 2 else harmless)()
        lead = " ".join(word() for _ in range(3)) + rng.choice([" ", "\n", ' "', "=", ": "])
        text = lead + body + rng.choice([" ", "\n", '" ', ", "]) + word()
        inside = any(s < len(lead) + len(body) and len(lead) < e for s, e, _ in base_spans(text))
        out.append((_views(text, len(lead), len(lead) + len(body)), k % 2, not inside))
    return out


#: Views of one finding of the documents that training takes; scans read all.
TAUGHT = 4


def labelled_views(text: str) -> list[tuple[str, int]]:
    """The text's own findings as the network sees them: base findings' values (1) and other candidates (0).

    Candidates that may be keys are not labelled: no base pattern tells what they are.
    """
    spans = base_spans(text)
    out = []
    for s, e, kind in spans:
        start = ASSIGN.match(text, s).start(2) if kind == "assign" else s
        out += [(v, 1) for v in _some(_views(text, start, e))]
    return out + [(v, 0) for s, e in candidates(text, spans) if not may_be_key(text[s:e]) for v in _some(_views(text, s, e))]


def _some(views: list[str]) -> list[str]:
    return views if len(views) <= TAUGHT else [views[k * (len(views) - 1) // (TAUGHT - 1)] for k in range(TAUGHT)]


def train_network(views: list[tuple[str, int]], seed: int = SEED, recall: float = RECALL) -> Network:
    """Fits, calibrates and returns the network.  Every fifth finding is held out for the calibration."""
    words = sorted({w for v, _ in views for w in v[:LEFT].strip("\0").split()[1:-1] if w.isalpha() and len(w) < 12})
    rows = [([v], k, False) for v, k in views] + made_up_findings(random.Random(seed), words if len(words) > 20 else [*words, "alpha", "river", "stone", "under", "paper"], MADE_UP)
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    net = Network.fresh(rng)
    parts = []
    for own in ([r for k, r in enumerate(rows) if k % 5], rows[::5]):
        owner = np.repeat(np.arange(len(own)), [len(v) for v, _, _ in own])
        parts.append((encode([x for v, _, _ in own for x in v]), owner, np.array([k for _, k, _ in own], float), np.array([n for _, _, n in own], bool)))
    codes, owner, y, _ = parts[0]
    net.train(codes, y[owner], rng)
    net.calibrate(*parts[1], recall)
    return net


def _view_batches(batches):
    for batch in batches:
        rows = [(h, v, k) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) for v, k in labelled_views(t)]
        h, v, k = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "view": pa.array(v, pa.string()), "label": pa.array(k, pa.int32())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_views: int = SAMPLE_VIEWS) -> Network:
    """Trains on the labelled findings of about sample_docs whole documents, picked by a hash of their ids."""
    h = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30))
    rows = docs.select(h.alias("h"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.where(F.col("h") < min(1.0, sample_docs / max(1, docs.count())) * (1 << 30))
    views = rows.mapInArrow(_view_batches, "h long, view string, label int").orderBy("h", "view", "label").limit(sample_views)
    return train_network([(r.view, r.label) for r in views.collect()])


#: Views that are scored at once.
SCORED = 8_192


def _best(best: dict, owner: list[tuple], scores: np.ndarray) -> None:
    for key, score in zip(owner, scores, strict=True):
        best[key] = max(score, best.get(key, 0.0))


def _scan_batches(batches, net: Network, redact: str | None):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found, views, owner, best = [], [], [], {}
        for k, t in enumerate(texts):
            spans = base_spans(t)
            found.append(spans)
            for s, e in candidates(t, spans):
                for v in _views(t, s, e):
                    views.append(v)
                    owner.append((k, s, e))
                    if len(views) >= SCORED:
                        _best(best, owner, net.score(encode(views)))
                        views, owner = [], []
        _best(best, owner, net.score(encode(views)))
        extra: dict[int, list] = {}
        for (k, s, e), score in best.items():
            if score >= net.threshold:
                extra.setdefault(k, []).append((s, e, "cnn"))
        rank = {kind: i for i, kind in enumerate((*KINDS, "cnn"))}
        everything = [sorted(f + extra[k], key=lambda s: (s[0], rank[s[2]])) if k in extra else f for k, f in enumerate(found)]
        join = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)
        if redact:
            out = pa.array([redacted(t, spans) if spans else None for t, spans in zip(texts, everything, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, redact])
            continue
        kinds = [[kind for _, _, kind in f] for f in found]
        cols = {"doc_id": batch.column("doc_id")} | {f"n_{kind}": pa.array([k.count(kind) for k in kinds], pa.int64()) for kind in KINDS}
        cols["base_sha256"] = pa.array([hashlib.sha256(join(f).encode()).hexdigest() for f in found], pa.string())
        cols["spans"] = pa.array([join(f) for f in everything], pa.string())
        cols["n_added"] = pa.array([len(extra.get(k, ())) for k in range(len(texts))], pa.int64())
        yield pa.RecordBatch.from_pydict(cols)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mask."""
    out, at, until = [], 0, 0
    for s, e, _ in spans:
        if s >= until:
            out += [text[at:s], MASK]
        until = at = max(until, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added), one row per row of docs.

    A null text is empty: no spans, and the hash of nothing.  Ids are passed on as they are, null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some tens of kilobytes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan_batches(it, shared.value, None), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with every span found masked in the text and n_chars, where there is one, made anew.

    Null texts stay null; ids, null or repeated, and all other columns, whatever their names, pass untouched.
    """
    shared = spark.sparkContext.broadcast(fit(docs))
    name = fresh_name(docs.columns, "redacted")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    out = docs.mapInArrow(lambda it: _scan_batches(it, shared.value, name), schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(name).isNotNull(), F.length(name).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(name, "text")).select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
