"""Secrets by fixed rules and a small character convolution over every other candidate.

Rules give the base findings. Every run of key-like characters that no base finding touches is a candidate; a convolution
over the characters of the candidate and of the text around it, pooled by place, gives its probability. The network
learns from every distinct finding that the rules label in all documents: findings are dealt to shards, each round trains
the network on every shard by itself and takes the mean of the weights. Its outputs are calibrated on all held-back
findings, and each kind of candidate gets the most precise threshold that still keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.functions.ordered import number_rows
from tokengraph.llm import common as C

# The base rules.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_=.-]{0,64}[0-9])[A-Za-z0-9+/_=.-]{16,}(?![@A-Za-z0-9])")
LEFT, FRAME, RIGHT = 24, 64, 12
WIDTH, FILTERS = 5, 24
CODES = 100
SHARD, ROUNDS, MEANS = 16_000, 8, 16
"""Findings per shard, rounds over all shards where there are several, and rows in which a round's weights reach the driver."""
RECALL, LEAST_LABELLED, HELD_BACK = 0.98, 20, 4
LOGIT_STEPS, LOGIT_MOST = 1024, 60
"""Logits of held-back findings are counted in steps of 1/1024 up to 60 either way, which bounds what the driver sees."""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order; kind is the place in ``KINDS``."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key-like characters with a digit, apart from the base findings."""
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][2] <= m.start():
            i += 1
        if not any(s < m.end() and e > m.start() for s, _, e in taken[i:] if s < m.end()):
            out.append(m.span())
    return out


def codes(s: str) -> np.ndarray:
    p = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((p >= 32) & (p < 127), p - 30, np.where(p < 32, 1, 98)).astype(np.int16)


def frames(left: str, value: str, right: str) -> np.ndarray:
    """One row of character codes per ``FRAME`` characters of the value, each with the text around the value."""
    a, c = np.zeros(LEFT, np.int16), np.zeros(RIGHT, np.int16)
    x, y = codes(left[-LEFT:]), codes(right[:RIGHT])
    a[LEFT - len(x) :] = x
    c[: len(y)] = y
    out = []
    for i in range(0, max(1, len(value)), FRAME):
        b = np.zeros(FRAME, np.int16)
        v = codes(value[i : i + FRAME])
        b[: len(v)] = v
        out.append(np.concatenate([a, b, c]))
    return np.array(out)


class Network:
    """Convolution, largest response per filter inside and around the value, logistic output."""

    PARTS = ((0, LEFT), (LEFT, LEFT + FRAME), (LEFT + FRAME, LEFT + FRAME + RIGHT))

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        self.w = (r.standard_normal((WIDTH, CODES, FILTERS)) * 0.3).astype(np.float32)
        self.w[:, 0] = 0
        self.b = np.zeros(FILTERS, np.float32)
        self.v = (r.standard_normal(len(self.PARTS) * FILTERS) * 0.1).astype(np.float32)
        self.c = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def pooled(self, x: np.ndarray):
        padded = np.pad(x, ((0, 0), (0, WIDTH - 1)))
        y = sum(self.w[k][padded[:, k : k + x.shape[1]]] for k in range(WIDTH)) + self.b
        best = [y[:, a:b].argmax(axis=1) + a for a, b in self.PARTS]
        return padded, best, np.hstack([np.take_along_axis(y, p[:, None], 1)[:, 0] for p in best])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x)[2], 0) @ self.v + self.c

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1000, size: int = 128, rate: float = 0.01, passes: int | None = None) -> None:
        r = np.random.RandomState(3)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        params = [self.w, self.b, self.v]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        at = np.arange(FILTERS)
        t = 0
        for _ in range(passes or max(ROUNDS, -(-steps * size // len(y)))):
            order = r.permutation(len(y))
            for i in range(0, len(y), size):
                pick = order[i : i + size]
                padded, best, h = self.pooled(x[pick])
                a = np.maximum(h, 0)
                likely = 1 / (1 + np.exp(-np.clip(a @ self.v + self.c, -30, 30)))
                # What no rule confirms may yet be a key: the more it looks like one, the less it is taught as an ordinary value.
                g = np.where(y[pick] > 0, likely - 1, likely * np.minimum(1, 2 * (1 - likely))) * weight[pick] / len(pick)
                gh = (g[:, None] * self.v) * (h > 0)
                gw = np.zeros_like(self.w)
                for j, p in enumerate(best):
                    part = gh[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                    for k in range(WIDTH):
                        np.add.at(gw[k], (np.take_along_axis(padded, p + k, 1), np.broadcast_to(at, p.shape)), part)
                gw[:, 0] = 0
                t += 1
                for p, grad, mm, ss in zip(params, (gw + 1e-4 * self.w, gh.reshape(len(pick), -1, FILTERS).sum((0, 1)), a.T @ g + 1e-4 * self.v), m, s):
                    mm += 0.1 * (grad - mm)
                    ss += 0.01 * (grad * grad - ss)
                    p -= (rate * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
                self.c -= np.float32(rate * 5 * g.sum())

    def calibrate(self, z: np.ndarray, y: np.ndarray, kinds: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """Logistic scaling of the logits of held-back findings, ``n`` of each, then per kind the most precise threshold with the wanted recall."""
        yes, no = n[y > 0].sum(), n[y == 0].sum()
        target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        def cost(a: float, b: float) -> float:
            t = a * z + b
            return float((n * (np.logaddexp(0, t) - target * t)).sum()) + 5e-4 * (a - 1) ** 2

        a, b, least = 1.0, 0.0, cost(1.0, 0.0)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            h = n * (p * (1 - p) + 1e-9)
            ga, gb = (n * (p - target) * z).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()
            haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-6
            det = haa * hbb - hab * hab
            da, db, part = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
            while part > 1e-6 and cost(a - part * da, b - part * db) >= least:  # a whole step can leave well separated findings behind
                part /= 2
            if part <= 1e-6:
                break
            a, b = a - part * da, b - part * db
            least = cost(a, b)
        self.scale, self.shift = float(a), float(b)
        p = self.scaled(z)
        for kind in ("hex", "mixed"):
            own = (y > 0) & (kinds == kind)
            own = np.flatnonzero(own if own.any() else y > 0)
            own = own[np.argsort(p[own])]
            upto = np.cumsum(n[own])
            high = float(p[own[np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]]) if len(own) else 1.1
            below = p[(y == 0) & (p < high)]  # thresholds between the two are equally precise here: take the middle
            self.thresholds[kind] = max(0.5, (high + float(below.max())) / 2 if len(below) else high)

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logit(x))

    def weights(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.b, self.v, [self.c]]).astype(np.float64)

    def set_weights(self, flat: np.ndarray) -> None:
        cuts = np.cumsum([self.w.size, self.b.size, self.v.size])
        w, b, v, c = np.split(flat.astype(np.float32), cuts)
        self.w, self.b, self.v, self.c = w.reshape(self.w.shape), b, v, c[0]


def kind_of(value: str) -> str:
    return "hex" if re.fullmatch(r"[0-9A-Fa-f-]+", value) else "mixed"


LABELLED = pa.schema([("label", pa.int64()), ("lefts", pa.string()), ("value", pa.string()), ("rights", pa.string())])


def findings(docs: DataFrame) -> DataFrame:
    """(label, lefts, value, rights): every distinct finding of all documents."""

    def run(batches):
        for r in C.rows_of(batches):
            t, rows = r["text"], []
            base = base_spans(t)
            spans = [(1, *(m.span(2) if (m := ASSIGN.match(t, s)) and k == 0 else (s, e))) for s, k, e in base]
            spans += [(0, s, e) for s, e in candidates(t, base)]
            spans += [(0, m.start(), m.end()) for m in NEUTRAL.finditer(t) if not any(s < m.end() and e > m.start() for s, _, e in base)][:2]
            for y, s, e in spans:
                rows.append({"label": y, "lefts": t[max(0, s - LEFT) : s], "value": t[s:e], "rights": t[e : e + RIGHT]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=LABELLED)

    return docs.mapInArrow(run, "label bigint, lefts string, value string, rights string").distinct()


NEUTRAL = re.compile(r"[^\s]{16,}")
"""Long words of any kind: what a key is not, beside the candidates that no rule confirms."""


def by_hash(found: DataFrame, label: int) -> DataFrame:
    """The findings of one label with their hash, the order in which they are numbered."""
    return found.where(F.col("label") == label).withColumn("hash", F.xxhash64("lefts", "value", "rights"))


ORDER = ["hash", "lefts", "value", "rights"]


def labelled_findings(docs: DataFrame, most: int) -> list:
    """The first ``most`` findings of each label by hash, to look at or to try the network on; ``scan`` learns from all."""
    found = C.cut(findings(docs))
    return [r for y in (0, 1) for r in by_hash(found, y).orderBy(*ORDER).limit(most).drop("hash").collect()]


def samples(pos: list, neg: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames, labels, whether of kind hex, and whether held back, of findings with their number ``i`` among those of their label."""
    rows = []
    for k, r in enumerate(pos):
        back = r["i"] % HELD_BACK == 0
        rows.append((frames(r["lefts"], r["value"], r["rights"])[0], 1, kind_of(r["value"]), back))
        if neg:
            other = neg[k * 7919 % len(neg)]  # the same value in ordinary surroundings: the value must do by itself
            rows.append((frames(other["lefts"], r["value"], other["rights"])[0], 1, kind_of(r["value"]), back))
            if k % 2:  # and in capitals
                rows.append((frames(other["lefts"], r["value"].upper(), other["rights"])[0], 1, kind_of(r["value"]), back))
    for k, r in enumerate(neg):
        back = r["i"] % HELD_BACK == 0
        rows.append((frames(r["lefts"], r["value"], r["rights"])[0], 0, kind_of(r["value"]), back))
        if k % 3 == 0 and pos:  # and an ordinary value after a keyword is no secret
            other = pos[k * 104729 % len(pos)]
            rows.append((frames(other["lefts"], r["value"], other["rights"])[0], 0, kind_of(r["value"]), back))
        if pos:  # and no surroundings speak against a key: one that no rule knows stands among the ordinary values
            value = pos[k * 15485863 % len(pos)]["value"]
            value = value.upper() if k % 2 else value
            rows.append((frames(r["lefts"], value, r["rights"])[0], 1, kind_of(value), back))
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64), np.array([r[2] == "hex" for r in rows]), np.array([r[3] for r in rows])


def trained(rows: list) -> Network | None:
    """A network of one shard, trained here. None where there are too few findings to learn from: then no span is added."""
    known = {r["value"] for r in rows if r["label"] == 1}
    pos = [r.asDict() | {"i": i} for i, r in enumerate(r for r in rows if r["label"] == 1)]
    neg = [r.asDict() | {"i": i} for i, r in enumerate(r for r in rows if r["label"] == 0 and r["value"] not in known)]
    if len(pos) < LEAST_LABELLED or len(neg) < LEAST_LABELLED:
        return None
    x, y, kinds, back = samples(pos, neg)
    net = Network()
    net.train(x[~back], y[~back])
    net.calibrate(net.logit(x[back]), y[back], np.where(kinds[back], "hex", "mixed"), np.ones(back.sum()))
    return net


SHARDS = pa.schema([("shard", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("kinds", pa.binary()), ("back", pa.binary())])
WEIGHTS = pa.schema([("weights", pa.binary()), ("n", pa.int64())])
LOGITS = pa.schema([("label", pa.int64()), ("hex", pa.int64()), ("z", pa.int64()), ("n", pa.int64())])


def shards(docs: DataFrame, shard: int = SHARD) -> DataFrame | None:
    """One row per shard with the samples of its findings; None where there are too few.

    Findings are dealt evenly by their number, and a label with few findings is dealt to several shards, so that each
    shard holds both. Held back is a finding by its number, so in every shard or in none.
    """
    found = C.cut(findings(docs))
    known = found.where("label = 1").select("value").distinct()
    both = {1: by_hash(found, 1), 0: by_hash(found, 0).join(known, "value", "left_anti")}
    both = {y: C.cut(number_rows(rows.select("label", *ORDER), ORDER, "i")) for y, rows in both.items()}
    n = {y: rows.count() for y, rows in both.items()}
    if min(n.values()) < LEAST_LABELLED:
        return None
    parts = -(-sum(n.values()) // shard)

    def dealt(y: int) -> DataFrame:
        copies = min(parts, max(1, -(-max(1, shard // 16) * parts // n[y])))
        j = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return both[y].withColumn("j", j).withColumn("shard", (F.floor(F.col("i") / HELD_BACK) + F.col("j")) % parts).drop("j")

    def run(batches):
        for at, rows in C.in_groups(C.rows_of(batches, 1024), lambda r: r["shard"]):
            rows = list(rows)
            made = samples([r for r in rows if r["label"] == 1], [r for r in rows if r["label"] == 0])
            yield C.batch(SHARDS, [[at], *[[C.pack(a)] for a in made]])

    rows = dealt(1).unionByName(dealt(0))
    tasks = min(parts, 2_000)
    return C.cut(rows.repartition(tasks, "shard").sortWithinPartitions("shard", "label", "i").mapInArrow(run, "shard bigint, x binary, y binary, kinds binary, back binary"))


def unpacked(r: dict, held_back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames, labels and kinds of the samples of a shard, held back or not."""
    pick = C.unpack(r["back"], bool) == held_back
    x = C.unpack(r["x"], np.int16).reshape(len(pick), -1)
    return x[pick], C.unpack(r["y"], np.float64)[pick], C.unpack(r["kinds"], bool)[pick]


def learned(docs: DataFrame, shard: int = SHARD) -> Network | None:
    """The network that all findings train, shard by shard; with one shard that is plain training."""
    dealt = shards(docs, shard)
    if dealt is None:
        return None
    context, parts = dealt.sparkSession.sparkContext, dealt.count()
    net = Network()

    def total(rows, width: int):
        flat, n = np.zeros(width), 0
        for r in rows:
            flat, n = flat + C.unpack(r["weights"], np.float64), n + r["n"]
        return flat, n

    for _ in range(ROUNDS if parts > 1 else 1):
        start = context.broadcast(net)

        def train(batches):
            for r in C.rows_of(batches, 1):
                own = Network()
                own.set_weights(start.value.weights())
                x, y, _ = unpacked(r, False)
                if len(y):
                    own.train(x, y, passes=1 if parts > 1 else None)
                yield C.batch(WEIGHTS, [[C.pack(own.weights() * len(y))], [len(y)]])

        def add(batches):
            flat, n = total(C.rows_of(batches, 16), len(start.value.weights()))
            yield C.batch(WEIGHTS, [[C.pack(flat)], [n]])

        sums = dealt.mapInArrow(train, "weights binary, n bigint").repartition(min(parts, MEANS)).mapInArrow(add, "weights binary, n bigint")
        flat, n = total(sums.collect(), len(net.weights()))
        net.set_weights(flat / max(1, n))

    final = context.broadcast(net)

    def logits(batches):
        for r in C.rows_of(batches, 1):
            x, y, kinds = unpacked(r, True)
            if not len(y):
                continue
            z = np.concatenate([final.value.logit(x[i : i + 2048]) for i in range(0, len(x), 2048)])
            z = np.round(np.clip(z, -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS).astype(np.int64)
            cells, n = np.unique(np.stack([y.astype(np.int64), kinds.astype(np.int64), z]), axis=1, return_counts=True)
            yield C.batch(LOGITS, [*cells, n])

    cells = dealt.mapInArrow(logits, "label bigint, hex bigint, z bigint, n bigint").groupBy("label", "hex", "z").agg(F.sum("n").alias("n")).orderBy("label", "hex", "z").collect()
    y, hexes, z, n = np.array([tuple(r) for r in cells], np.float64).T
    net.calibrate(z / LOGIT_STEPS, y, np.where(hexes > 0, "hex", "mixed"), n)
    return net


MADE = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def scan(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per input row: counts of the base findings, their digest, and all spans (added ones of kind ``cnn``).

    A null or empty text has no span. A null id keeps its row. Other columns are not carried. ``shard`` is the number of
    findings that a task learns from at a time.
    """
    src = C.texts(docs)
    model = src.sparkSession.sparkContext.broadcast(learned(src, shard))

    def run(batches):
        net = model.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found, asked, values = [], [], []
                for j, t in enumerate(b.column("text").to_pylist()):
                    base = base_spans(t)
                    found.append(base)
                    if net is not None:
                        for s, e in candidates(t, base):
                            x = frames(t[max(0, s - LEFT) : s], t[s:e], t[e : e + RIGHT])
                            asked.append((j, s, e, kind_of(t[s:e]), len(x)))
                            values.append(x)
                added: list[list] = [[] for _ in found]
                if asked:
                    p = net.probability(np.concatenate(values))
                    at = 0
                    for j, s, e, kind, n in asked:
                        if p[at : at + n].max() >= net.thresholds[kind]:
                            added[j].append((s, 3, e))
                        at += n
                rows = []
                for d, base, more in zip(b.column("doc_id").to_pylist(), found, added):
                    shown = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                    n = [sum(k == x for _, k, _ in base) for x in range(3)]
                    both = ",".join(f"{(*KINDS, 'cnn')[k]}:{s}:{e}" for s, k, e in sorted(base + more))
                    rows.append({"doc_id": d, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(shown.encode()).hexdigest(), "spans": both, "n_added": len(more)})
                yield pa.RecordBatch.from_pylist(rows, schema=MADE)

    return src.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")
