"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns give the base spans. Every other run of key-like characters is a candidate; a small network,
written and trained in numpy, reads its characters and those around it, in overlapping windows over the whole
length, of which the best one counts. It is trained on every labelled finding of all documents (parts of candidates
that a pattern confirms against those that none does), copies once, and on a few fixed ones besides. Findings are
dealt to tasks, each of which descends over its own from the same weights; the weights are averaged after every
round. A fifth of all findings is kept from the training; all of these calibrate the network, and its threshold is the
largest one that still finds the asked share of the confirmed ones among them.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches

SHARD = 10_000  # findings that a task trains on between two averages of the weights, as long as
MOST_SHARDS = 64  # tasks of a round are not as many as this; from there on each trains on more
PLACES = 1 << 30  # findings are dealt by a hash below this
VISITS = 150_000  # findings read in training, all passes together: few findings are read up to MOST_PASSES times,
LEAST_PASSES, MOST_PASSES = 2, 4  # and however many there are, every one of them at least LEAST_PASSES times
KEPT = 5  # one finding in so many is kept for calibration
TRAIN_WINDOWS = 64  # windows of one finding that the training reads, at even distances; scoring reads all
SEED_FINDINGS = 200  # a class with fewer findings in the documents gets so many fixed ones besides
RECALL = 0.98  # share of the confirmed findings kept for calibration that the threshold has to find
BEFORE, INSIDE, AFTER = 24, 40, 8  # characters of context and candidate that the network reads
WIDTH = BEFORE + INSIDE + AFTER

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones can be passed over at once
KINDS = ("assign", "access", "hex", "network")

HINTS = ("passw", "secret", "token", "apikey", "api_key")  # a text without any of them has no assignment
CANDIDATE_LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' findings; each kind from the left, without overlap."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 12 or more key characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def merged(base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover together, as spans in order that do not touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def parts(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, label) of the parts of every candidate: 1 for what base spans cover, 0 for the rest of it.

    Parts of fewer than 12 characters are passed over, like runs of so few.
    """
    covers = merged(base)
    at = 0
    for start, end in candidates(text):
        while at < len(covers) and covers[at][1] <= start:
            at += 1
        here, k = start, at
        while k < len(covers) and covers[k][0] < end:
            s, e = max(covers[k][0], start), min(covers[k][1], end)
            if s - here >= CANDIDATE_LEAST:
                yield here, s, 0
            if e - s >= CANDIDATE_LEAST:
                yield s, e, 1
            here, k = e, k + 1
        if end - here >= CANDIDATE_LEAST:
            yield here, end, 0


def places(start: int, end: int) -> range | list[int]:
    """Starts of the overlapping windows that cover a candidate: each half a window on, the last at its end."""
    if end - start <= INSIDE:
        return [start]
    return [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]


def windows_of(text: str, start: int, end: int, most: int | None = None) -> Iterator[bytes]:
    """The windows of a candidate over its whole length, or `most` of them at even distances."""
    at = places(start, end)
    if most is not None and len(at) > most:
        at = [at[i * (len(at) - 1) // (most - 1)] for i in range(most)]
    for s in at:
        yield window(text, s, min(end, s + INSIDE))


def window(text: str, start: int, end: int) -> bytes:
    """The characters the network reads; 0 pads, and characters beyond ASCII count as one."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inner = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    right = text[end : end + AFTER].ljust(AFTER, "\0")
    return (left + inner + right).encode("ascii", "replace")


def encode(windows: list[bytes]) -> np.ndarray:
    codes = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WIDTH).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes == 0, 0, 96))


@dataclass
class Network:
    """Embedding, one convolution of width 5, maxima and means over context and candidate, one output."""

    embed: np.ndarray  # 97 x 8
    filters: np.ndarray  # 40 x 16
    bias: np.ndarray  # 16
    out: np.ndarray  # 64
    shift: np.ndarray  # 1
    scale: float = 1.0  # calibration: probability = 1 / (1 + exp(-(scale * output + offset)))
    offset: float = 0.0
    threshold: float = 1.0

    TAPS = 5

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (97, 8)), rng.normal(0, 0.25, (8 * cls.TAPS, 16)), np.zeros(16),
            rng.normal(0, 0.2, 64), np.zeros(1),
        )

    def forward(self, codes: np.ndarray):
        steps = WIDTH - self.TAPS + 1
        chars = self.embed[codes]
        stacked = np.concatenate([chars[:, k : k + steps] for k in range(self.TAPS)], axis=2)
        active = np.maximum(stacked @ self.filters + self.bias, 0)
        parts = (active[:, :BEFORE], active[:, BEFORE:])
        pooled = np.concatenate([f(p, axis=1) for p in parts for f in (np.max, np.mean)], axis=1)
        return stacked, active, pooled, pooled @ self.out + self.shift[0]

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> list[np.ndarray]:
        stacked, active, pooled, raw = self.forward(codes)
        error = (weights * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / len(labels)).astype(raw.dtype)
        toward = error[:, None] * self.out
        back = np.zeros_like(active)
        for i, (low, high) in enumerate(((0, BEFORE), (BEFORE, active.shape[1]))):
            part, grad = active[:, low:high], back[:, low:high]
            top = part.argmax(axis=1)[:, None, :]
            np.put_along_axis(grad, top, toward[:, None, 32 * i : 32 * i + 16], axis=1)
            grad += toward[:, None, 32 * i + 16 : 32 * i + 32] / (high - low)
        back *= active > 0
        flat = back.reshape(-1, back.shape[2])
        to_chars = back @ self.filters.T
        at_chars = np.zeros((*codes.shape, 8), dtype=to_chars.dtype)
        steps = active.shape[1]
        for k in range(self.TAPS):
            at_chars[:, k : k + steps] += to_chars[:, :, 8 * k : 8 * k + 8]
        embed = np.stack([np.bincount(codes.ravel(), at_chars[:, :, d].ravel(), len(self.embed)) for d in range(8)], axis=1)
        return [embed, stacked.reshape(len(flat), -1).T @ flat, flat.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for at in range(0, len(codes), 256):  # keeps the arrays of a step small
            out[at : at + 256] = self.forward(codes[at : at + 256])[3]
        return likelihood(self, out)


WEIGHTS = ("embed", "filters", "bias", "out", "shift")


class Descent:
    """Adam over the weights of a network in single precision: these, both moments, and the number of steps so far.

    Weights decay: what no pattern confirms counts as no key, so among the findings there are keys that are not to be
    learnt by heart as something else.
    """

    RATE, DECAY = 0.01, 0.3

    def __init__(self, net: Network):
        self.net = net
        for name in WEIGHTS:
            setattr(net, name, getattr(net, name).astype(np.float32))
        self.weights = [getattr(net, name) for name in WEIGHTS]
        self.first, self.second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        self.steps = 0

    def step(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> None:
        self.steps += 1
        grads = self.net.gradients(codes, labels, weights)
        for w, g, m, v in zip(self.weights, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moved = (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            w -= self.RATE * (moved + self.DECAY * w)

    def trained(self) -> Network:
        """The network in double precision, which scores are made in."""
        for name in WEIGHTS:
            setattr(self.net, name, getattr(self.net, name).astype(np.float64))
        return self.net

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*self.weights, *self.first, *self.second)])

    def restore(self, state: np.ndarray, steps: int) -> Descent:
        at = 0
        for a in (*self.weights, *self.first, *self.second):
            a[...] = state[at : at + a.size].reshape(a.shape)
            at += a.size
        self.steps = steps
        return self


def train(
    windows: list[bytes], labels: np.ndarray, recall: float = RECALL, seed: int = 7, epochs: int = 12, of: np.ndarray | None = None
) -> Network | None:
    """A trained, calibrated network, or None where a class has fewer than 20 windows.

    `of` numbers the finding of each window, windows of a finding in a row; without it each is its own finding. Every
    fifth finding is kept for calibration. Half of the training windows appear with their left context
    blanked as well, so that the network learns what keys look like and not only the words before them.
    """
    if min(labels.sum(), (1 - labels).sum()) < 20:
        return None
    codes, labels = encode(windows), labels.astype(float)
    of = np.arange(len(labels)) if of is None else of
    kept = np.zeros(len(labels), dtype=bool)
    for value in (0, 1):
        kept |= np.isin(of, np.unique(of[labels == value])[::5])
    rng = np.random.default_rng(seed)
    blank = codes[~kept][::2].copy()
    blank[:, :BEFORE] = 0
    x, y = np.concatenate([codes[~kept], blank]), np.concatenate([labels[~kept], labels[~kept][::2]])
    descent = Descent(Network.start(seed))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            descent.step(x[order[at : at + 64]], y[order[at : at + 64]])
    net = descent.trained()
    return calibrate(net, codes[kept], labels[kept], recall, of[kept])


def calibrate(net: Network, codes: np.ndarray, labels: np.ndarray, recall: float, of: np.ndarray) -> Network:
    """Logistic scaling of the best outputs of findings the network has not seen, then the threshold."""
    raw = np.concatenate([net.forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)])
    first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
    raw, labels = np.maximum.reduceat(raw, first), labels[first]
    scaling(net, raw, labels, np.ones(len(raw)))
    found = np.sort(raw[labels == 1])
    net.threshold = float(likelihood(net, found[int(np.floor((1 - recall) * len(found)))]))
    return net


def likelihood(net: Network, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale * raw + net.offset, -40, 40)))


def scaling(net: Network, raw: np.ndarray, labels: np.ndarray, times: np.ndarray) -> None:
    """Logistic scaling of outputs, each of which stands for so many findings of its label."""
    total, positive = times.sum(), times[labels == 1].sum()
    aim = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
    share, scale, offset = times / total, 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * raw + offset, -40, 40)))
        scale -= 0.1 * (((p - aim) * raw * share).sum() / (1 + (raw * raw * share).sum()) + 1e-4 * scale)
        offset -= 0.1 * ((p - aim) * share).sum()
    net.scale, net.offset = float(scale), float(offset)


def overlaps(spans: list[tuple[str, int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for _, s, e in spans)


def scored(text: str, base: list[tuple[str, int, int]], net: Network) -> list[tuple[int, int, float]]:
    """(start, end, score) of every part of a candidate that no base span covers; the score is its best window's."""
    open_ = [(s, e) for s, e, label in parts(text, base) if not label]
    best = np.zeros(len(open_))
    listed = ((i, w) for i, c in enumerate(open_) for w in windows_of(text, *c))
    while some := list(itertools.islice(listed, 1024)):
        np.maximum.at(best, [i for i, _ in some], net.probability(encode([w for _, w in some])))
    return [(s, e, float(p)) for (s, e), p in zip(open_, best, strict=True)]


def spans_of(text: str | None, net: Network | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text by start and kind: base ones with score 1, and candidates the network accepts."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, 1.0) for s in base]
    if net is not None:
        found += [("network", s, e, p) for s, e, p in scored(text, base, net) if p >= net.threshold]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class _Least:
    """The `most` distinct findings of least hash among those added."""

    def __init__(self, most: int):
        self.most, self.held, self.bound = most, {}, None

    def add(self, at: int, windows: bytes) -> None:
        if self.bound is None or at <= self.bound:
            self.held[at, windows] = None
            if len(self.held) >= 2 * self.most + 64:
                self.cut()

    def cut(self) -> list[tuple[int, bytes]]:
        least = sorted(self.held)[: self.most]
        self.held = dict.fromkeys(least)
        if len(least) == self.most:
            self.bound = least[-1][0]
        return least


FINDING = "at long, windows binary, label long, shape long"


def _hash(windows: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(windows, digest_size=8).digest(), "big", signed=True)


def _findings(most: int | None = None):
    """The distinct findings of each batch: at, windows one after the other, label, shape (whether there is a digit).

    With `most`, of each partition only so many of least hash per class and shape.
    """

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["at", "windows", "label", "shape"]).astype(
            {"at": "int64", "label": "int64", "shape": "int64"}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = {(label, shape): _Least(most) for label in (0, 1) for shape in (0, 1)} if most is not None else {}
        for batch in batches:
            found = {}
            for text in batch["text"]:
                for s, e, label in parts(text, base_spans(text)):
                    windows = b"".join(windows_of(text, s, e, TRAIN_WINDOWS))
                    found[windows, label, int(DIGIT.search(text, s, e) is not None)] = None
            if most is None:
                yield frame([(_hash(w), w, label, shape) for w, label, shape in found])
            else:
                for w, label, shape in found:
                    least[label, shape].add(_hash(w), w)
        if most is not None:
            yield frame([(at, w, *k) for k, held in least.items() for at, w in held.cut()])

    return run


def seed_findings(label: int, n: int = SEED_FINDINGS) -> list[bytes]:
    """Fixed findings of a class, always the same: keys of five kinds in short contexts, or words, paths, numbers and names."""
    rng = random.Random(f"secret_scans {label}")
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def of(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def word(low: int = 2, high: int = 4) -> str:
        return "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(low, high)))

    keys = (
        lambda: of(digits + "abcdef", 32, 64),
        lambda: "AKIA" + of(letters.upper() + digits, 16, 16),
        lambda: of(letters + letters.upper() + digits, 20, 44),
        lambda: of(letters + letters.upper(), 20, 40),
        lambda: of(letters + letters.upper() + digits + "+/", 24, 44) + "==",
    )
    plain = (
        lambda: word(6, 10),
        lambda: "/".join(word() for _ in range(rng.randint(4, 9))) + rng.choice(["", ".html", ".py"]),
        lambda: of(digits, 12, 20),
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + of(digits, 0, 3),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 5))),
        lambda: f"www.{word()}.{word()}.com/{word()}/{rng.randint(1, 9999)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: rng.choice("-=._") * rng.randint(12, 60),
    )
    kinds, out = (keys if label else plain), []
    for i in range(n):
        left = " ".join(word() for _ in range(5)) + rng.choice([" ", ": ", " = ", ' "', "\n"])
        middle = kinds[i % len(kinds)]()
        text = left + middle + rng.choice([" ", ".\n", '"', ", "]).replace(".", " ") + word()
        out.append(b"".join(windows_of(text, len(left), len(left) + len(middle), TRAIN_WINDOWS)))
    return out


def _seeds() -> list[tuple[int, bytes, int, int]]:
    """The fixed findings of both classes as rows; of no text, so the shape is told by the candidate's own characters."""
    inner = slice(BEFORE, BEFORE + INSIDE)
    return [
        (_hash(w), w, label, int(any(DIGIT.search(w[at : at + WIDTH][inner].decode()) for at in range(0, len(w), WIDTH))))
        for label in (0, 1)
        for w in seed_findings(label)
    ]


def rounds(n: int) -> list[tuple[int, int, int, int]]:
    """(low, high, shards, passes) of each round over `n` findings: places from low to below high, dealt to shards.

    The first pass goes over ever larger parts, four times as many findings each, so that tasks begin from weights that
    are no longer at random; later passes take all findings at once. What one shard holds is read by one task.
    """
    passes = min(MOST_PASSES, max(LEAST_PASSES, -(-VISITS // max(1, n))))
    shards = lambda share: max(1, min(MOST_SHARDS, -(-int(n * share) // SHARD)))
    if shards(1) == 1:
        return [(0, PLACES, 1, passes)]
    out, low, size = [], 0, SHARD
    while low < PLACES:
        high = min(PLACES, low + PLACES * size // n)
        if PLACES - high < PLACES * size // n:  # a small rest goes with the part before it
            high = PLACES
        out.append((low, high, shards((high - low) / PLACES), 1))
        low, size = high, 4 * size
    return out + [(0, PLACES, shards(1), 1)] * (passes - 1)


def _shard_steps(state: np.ndarray, steps: int, weight: dict[tuple[int, int], float], passes: int):
    """Of each shard, whose findings come in order: the state after its steps over them, how many steps, how many findings.

    Half of the findings appear with their left context blanked as well, so that the network learns what keys look
    like and not only the words before them. A few findings are held at once; a shard with several passes is held whole.
    """
    def learn(descent: Descent, found: list[tuple[bytes, int, int]]) -> None:
        windows, y, w = [], [], []
        for i, (joined, label, shape) in enumerate(found):
            each = [joined[at : at + WIDTH] for at in range(0, len(joined), WIDTH)]
            copies = [b"\0" * BEFORE + x[BEFORE:] for x in each] if i % 2 == 0 else []
            windows += each + copies
            y += [label] * (len(each) + len(copies))
            w += [weight[label, shape]] * (len(each) + len(copies))
        codes, y, w = encode(windows), np.array(y, dtype=float), np.array(w)
        for at in range(0, len(y), 64):
            descent.step(codes[at : at + 64], y[at : at + 64], w[at : at + 64])

    def one(rows: Iterator[tuple[bytes, int, int]]) -> tuple[bytes, int, int]:
        descent, seen = Descent(Network.start(0)).restore(state, steps), 0
        held = list(rows) if passes > 1 else rows
        for number in range(passes):
            if number:
                np.random.default_rng(number).shuffle(held)
            left = iter(held)
            while some := list(itertools.islice(left, 64)):
                learn(descent, some)
                seen += len(some)
        return descent.state().tobytes(), descent.steps - steps, seen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["shard"], b["windows"], b["label"], b["shape"], strict=True))
        for shard, own in itertools.groupby(rows, key=lambda r: r[0]):
            yield pd.DataFrame([(shard, *one((bytes(w), la, sh) for _, w, la, sh in own))], columns=["shard", "state", "steps", "n"])

    return run


def _best_output(net: Network):
    """Of each finding its label and the best output of its windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            of = np.repeat(np.arange(len(batch)), [len(w) // WIDTH for w in batch["windows"]])
            codes = encode([b"".join(map(bytes, batch["windows"]))])
            raw = np.concatenate([net.forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)])
            yield pd.DataFrame({"label": batch["label"], "raw": np.maximum.reduceat(raw, np.flatnonzero(np.diff(of, prepend=-1)))})

    return run


def fit(docs: DataFrame, recall: float = RECALL, seed: int = 7) -> Network:
    """A network trained and calibrated on all labelled findings of all documents, copies once, none left out.

    Each class gets SEED_FINDINGS fixed ones besides, so every input has a network. Classes and shapes (with a digit or
    without) weigh as the square root of what they are, so that words do not crowd out what looks more like a key. Only
    weights, counts and outputs in bins come to the driver; which task trains on a finding is told by its hash alone.
    """
    spark = docs.sparkSession
    text_batches(spark)
    found = docs.filter("text is not null").select("text").mapInPandas(_findings(), FINDING)
    found = found.unionByName(spark.createDataFrame(_seeds(), FINDING)).distinct()
    found = stage(found.withColumn("place", F.pmod(F.xxhash64("at", "label"), F.lit(PLACES))), "findings")
    kept = F.pmod("at", F.lit(KEPT)) == 0
    counts = {(r["label"], r["shape"]): r["count"] for r in found.filter(~kept).groupBy("label", "shape").count().collect()}
    n = sum(counts.values())
    weight = {k: (n / c) ** 0.5 for k, c in counts.items()}
    mean = sum(weight[k] * c for k, c in counts.items()) / n
    weight = {k: w / mean for k, w in weight.items()}
    descent = Descent(Network.start(seed))
    for low, high, shards, passes in rounds(n):
        part = found.filter(~kept & F.col("place").between(low, high - 1)).withColumn("shard", F.col("place") % shards)
        dealt = part.repartition(shards, "shard").sortWithinPartitions("shard", "place", "windows", "label", "shape")
        steps = _shard_steps(descent.state(), descent.steps, weight, passes)
        done = dealt.select("shard", "windows", "label", "shape").mapInPandas(steps, "shard long, state binary, steps long, n long")
        done = sorted(done.collect(), key=lambda r: r["shard"])  # the weights of at most MOST_SHARDS tasks
        mean = sum(np.frombuffer(r["state"], np.float32).astype(float) * r["n"] for r in done) / sum(r["n"] for r in done)
        descent.restore(mean, descent.steps + max(r["steps"] for r in done))
    return _calibrated(descent.trained(), found.filter(kept), recall)


BINS = 64  # bins of a unit of output that the scaling of scores reads; the threshold is an output itself


def _calibrated(net: Network, kept: DataFrame, recall: float) -> Network:
    """Logistic scaling of the outputs of all kept findings, and the threshold, taken from the confirmed ones in order."""
    outputs = stage(kept.select("windows", "label").mapInPandas(_best_output(net), "label long, raw double"), "outputs")
    place = F.round(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("raw"))) * BINS)
    binned = outputs.groupBy("label", place.alias("bin")).agg(F.count("*").alias("n")).orderBy("label", "bin").toPandas()
    scaling(net, binned["bin"].to_numpy() / BINS, binned["label"].to_numpy(), binned["n"].to_numpy(dtype=float))
    confirmed = outputs.filter("label = 1").select("raw")
    passed = int(np.floor((1 - recall) * binned.loc[binned["label"] == 1, "n"].sum()))
    net.threshold = float(likelihood(net, confirmed.orderBy("raw").offset(passed).limit(1).first()["raw"]))
    return net


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_secrets(docs: DataFrame, net: Network | None) -> DataFrame:
    """`docs` with `spans` (in place of a column of that name): kind, start, end (code points, exclusive), score.

    Null and empty texts have no span. Without a network only base spans are found. Rows are judged one by one:
    repeated rows alike, whole texts of any length, no rows for no documents; other columns are kept unread.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(SPAN)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(
                [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t, held.value)] for t in batch]
            )

    return docs.select(*[c for c in docs.columns if c != "spans"], scan("text").alias("spans"))


def _named(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: findings of each base kind, a hash of the base spans, and all spans as text."""
    docs = docs.select("doc_id", "text")
    found = find_secrets(docs, fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "network")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("network"),
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"),
    )
