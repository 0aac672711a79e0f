"""Secret scans: three base patterns, and a character convolutional network over every candidate.

Candidates are the base matches and every run of ``[A-Za-z0-9+/_.=-]`` of 16 characters or more; of a
run that base matches overlap, what they leave of it, if that is as long. The network (numpy only)
reads a candidate together with the characters around it, a long one in overlapping frames over its
whole length, of which the highest score counts: one-hot character classes, one layer of convolutions,
the largest response of each filter, and a logistic output. It is trained on labelled findings; its
scores are calibrated by Platt scaling on findings that training hasn't seen, and the threshold is the
highest at which recall on these still reaches ``MIN_RECALL``. Base matches always stay; other
candidates become findings of kind ``cnn`` when their calibrated score reaches the threshold. Every
finding, base ones included, has its score.

The labelled findings come from ``labelled()`` and ``long_runs()``: ``TRAIN_ROWS`` and ``LONG_ROWS``
generated ones by a fixed seed, secrets of common makes and look-alikes that are none, alone and
anywhere in long runs. Those bounds are parameters; every text is scanned whole.

Defined cases: null or empty text has no findings (base_sha256 of the empty string); repeated rows
are scanned one by one; very long texts and candidates are scanned whole, a bounded number of frames at
a time; findings that start together are ordered by kind as listed; an empty table gives an empty
result; other columns stay out of the plan, and in ``stage()`` they stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The base patterns, by kind, with the group and the least length that it must have.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "cnn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST = 16
TRAIN_ROWS = 4000
MIN_RECALL = 0.97
SEED = 5
LONG_ROWS = 1000
LEFT, BODY, RIGHT = 20, 44, 8
STRIDE = BODY // 4
WIDTH, FILTERS = 5, 32
BATCH = 512
#: Frames that are scored together.
FRAMES = 16384

#: Classes of characters: every letter and case has its own, the others here share theirs
#: by group; all else is 1, and 0 is padding.
_CLASSES = np.full(128, 1, np.uint8)
for _n, _chars in enumerate((*string.ascii_letters, "02468", "13579", "-", "_", "+/", "=", ".", " ", "\n\t", ":", "\"'`", "@", "&?", "#%"), 2):
    for _c in _chars:
        _CLASSES[ord(_c)] = _n
N_CLASSES = int(_CLASSES.max()) + 1


#: Syllables and endings of English, German, French and Spanish, for look-alikes.
SYLLABLES = (
    "th the er an and in ing on re ou st ti at en nd or es is it ar te se hi nt ed le al ent ion tion ment ness able ly ous "
    "sch ein ich keit heit ung ge be ver zu ch lich isch der die nicht und aux eau eux elle ique ette que les des pour ado idad los las mente illo para con por"
).split()


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str


def base_findings(text: str) -> list[Finding]:
    """The base matches by start, then kind; code points, end exclusive."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [Finding(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind)))


def candidates(text: str, taken: list[Finding]) -> list[tuple[int, int]]:
    """Spans of candidates beside the base matches ``taken``, which are in the order of their starts."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not taken:
        return found
    out, first = [], 0
    for a, b in found:
        while first < len(taken) and taken[first].end <= a:
            first += 1
        at = a
        for f in taken[first:]:
            if f.start >= b:
                break
            if f.start - at >= LEAST:
                out.append((at, f.start))
            at = max(at, f.end)
        if b - at >= LEAST:
            out.append((at, b))
    return out


def classes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(raw < 128, _CLASSES[np.minimum(raw, 127)], 1)


def window(text: str, start: int, end: int) -> np.ndarray:
    """The character classes of a candidate of up to ``BODY`` characters, or of the first ones of a
    longer one, with its context, in a fixed frame."""
    out = np.zeros(LEFT + BODY + RIGHT, np.uint8)
    for piece, at in ((text[max(0, start - LEFT) : start], LEFT - min(LEFT, start)), (text[start : min(end, start + BODY)], LEFT), (text[end : end + RIGHT], LEFT + BODY)):
        raw = classes(piece)
        out[at : at + len(raw)] = raw
    return out


def windows(text: str, start: int, end: int) -> np.ndarray:
    """The frames of a whole candidate: one, or of a longer one than ``BODY`` a frame every ``STRIDE``
    characters and one at its end, each with what stands around it in the text."""
    if end - start <= BODY:
        return window(text, start, end)[None]
    left, right = min(LEFT, start), min(RIGHT, len(text) - end)
    raw = np.pad(classes(text[start - left : end + right]), (LEFT - left, RIGHT - right))
    at = np.append(np.arange(0, end - start - BODY, STRIDE), end - start - BODY)
    return np.lib.stride_tricks.sliding_window_view(raw, LEFT + BODY + RIGHT)[at]


class Network:
    """Convolution of ``WIDTH`` characters, ReLU, maximum over positions, logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = r.normal(0, 0.15, (WIDTH, N_CLASSES, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.c = np.float32(0)
        self.slope, self.shift = 1.0, 0.0
        #: Of candidates that one frame holds, and of longer ones.
        self.thresholds = (0.5, 0.5)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Of each window, position and filter. A one-hot input makes the product a lookup."""
        n = x.shape[1] - WIDTH + 1
        return sum(self.w[k][x[:, k : k + n]] for k in range(WIDTH)) + self.b

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.responses(x[i : i + 512]), 0).max(1) @ self.v + self.c for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def score_whole(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Of each candidate, (text, start, end), the highest calibrated probability of its frames."""
        out: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0
        for i, f in enumerate(found):
            held.append(windows(*f))
            size += len(held[-1])
            if size >= FRAMES or i == len(found) - 1:
                starts = np.cumsum([0, *map(len, held[:-1])])
                out.append(np.maximum.reduceat(self.score(np.concatenate(held)), starts))
                held, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, rate: float = 0.01, batch: int = 64, seed: int = SEED) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        names = ("w", "b", "v", "c")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(rounds):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
                z = self.responses(xs)
                best = z.argmax(1)
                top = np.take_along_axis(z, best[:, None, :], 1)[:, 0, :]
                pooled = np.maximum(top, 0)
                error = (1 / (1 + np.exp(-(pooled @ self.v + self.c))) - ys) / len(ys)
                back = error[:, None] * self.v * (top > 0)
                grad = {"v": pooled.T @ error, "c": error.sum(), "b": back.sum(0), "w": np.zeros_like(self.w)}
                f = np.broadcast_to(np.arange(FILTERS), best.shape)
                rows = np.arange(len(xs))[:, None]
                for k in range(WIDTH):
                    np.add.at(grad["w"][k], (xs[rows, best + k], f), back)
                step += 1
                for k in names:
                    g = grad[k] + 1e-4 * getattr(self, k)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, found: list[tuple[str, int, int]], y: np.ndarray, min_recall: float = MIN_RECALL) -> None:
        """Platt scaling by Newton steps, then the highest thresholds that keep ``min_recall``: one of
        candidates that one frame holds, one of longer ones."""
        frames = [windows(*f) for f in found]
        z = np.maximum.reduceat(self.raw(np.concatenate(frames)).astype(float), np.cumsum([0, *map(len, frames[:-1])]))
        ys = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a = np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-design @ a))
            h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            a = a - np.linalg.solve(h, design.T @ (p - ys))
        self.slope, self.shift = map(float, a)
        scores, long = self.score_whole(found), np.array([end - start > BODY for _, start, end in found])
        each = [np.sort(scores[(y > 0) & kind]) for kind in (~long, long)]
        self.thresholds = tuple(float(hits[int(np.floor((1 - min_recall) * len(hits)))]) if len(hits) else 1.0 for hits in each)

    def is_secret(self, start: int, end: int, score: float) -> bool:
        return score >= self.thresholds[end - start > BODY]

    def secrets(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Which candidates reach their threshold."""
        return np.array([self.is_secret(a, b, p) for (_, a, b), p in zip(found, self.score_whole(found))], bool)


def long_runs(rows: int = LONG_ROWS, seed: int = SEED) -> tuple[list[tuple[str, int, int]], np.ndarray, list[tuple[int, int]]]:
    """Generated candidates of more than ``BODY`` characters, (text, start, end) each, 1 for those
    that hold a secret, and where it is: at the start, in the middle or at the end. The parts are those
    of ``labelled()``, joined as paths, dotted names and assignments."""
    found, y = labelled(2 * rows, seed + 1)
    parts: tuple[list[str], list[str]] = ([], [])
    for (text, start, end), secret in zip(found, y):
        parts[int(secret)].append(re.sub(r"[^A-Za-z0-9+/_.=-]", "n", text[start:end]))
    r = np.random.default_rng(seed + 2)
    pick = lambda xs: xs[r.integers(len(xs))]
    runs, labels, places = [], [], []
    for i in range(rows):
        own = [pick(parts[0]) for _ in range(r.integers(3, 8))]
        while sum(map(len, own)) <= BODY:
            own.append(pick(parts[0]))
        joined = [p + pick("/.=_-/./.") for p in own]
        at, secret = int(r.integers(len(own) + 1)), pick(parts[1]) if i % 2 else ""
        left = pick(("see ", "at ", "http://", "in (", "")) + "".join(joined[:at])
        run = left + secret + (pick("/.=_-") if secret and at < len(own) else "") + "".join(joined[at:])[:-1]
        start = len(left) - len("".join(joined[:at]))
        runs.append((run + pick((" ", ". ", "\n", ") ")) + "and on", start, len(run)))
        labels.append(i % 2)
        places.append((len(left), len(left) + len(secret)))
    return runs, np.array(labels, np.float32), places


def long_frames(found: list[tuple[str, int, int]], y: np.ndarray, places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Frames to fit on: 1 for those that hold a secret, or ``BODY - STRIDE`` characters of it, 0 for
    those without any of it; what holds less of it is left out."""
    frames, labels = [], []
    for (text, start, end), secret, (a, b) in zip(found, y, places):
        own = windows(text, start, end)
        at = start + np.append(np.arange(0, end - start - BODY, STRIDE), end - start - BODY)
        both = np.minimum(at + BODY, b) - np.maximum(at, a)
        fit = (both <= 0) | (both >= min(b - a, BODY - STRIDE)) if secret else np.ones(len(own), bool)
        frames.append(own[fit])
        labels.append((both[fit] > 0) & (secret > 0))
    return np.concatenate(frames), np.concatenate(labels).astype(np.float32)


def labelled(rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Generated findings, (text, start, end) each, and 1 for those that are secrets."""
    r = np.random.default_rng(seed)
    pick = lambda s, n: "".join(r.choice(list(s), n))
    one = lambda *xs: xs[r.integers(len(xs))]
    alnum, low_hex = string.ascii_letters + string.digits, "0123456789abcdef"
    vowels, others = "aeiou", "bcdfghjklmnprstvwz"
    syllable = lambda: one(*SYLLABLES) if r.random() < 0.6 else one(*others) + one(*vowels) + (one(*others) if r.random() < 0.4 else "")
    word = lambda a=3, b=10: "".join(syllable() for _ in range(r.integers(a, b) // 2 + 1))

    def secret() -> str:
        return one(
            lambda: "gh" + one("p", "o", "s") + "_" + pick(alnum, 36), lambda: "sk" + one("-", "_live_", "_test_") + pick(alnum, r.integers(20, 44)),
            lambda: "xox" + one("b", "p") + "-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "-_", 35),
            lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "-_", 30) + "." + pick(alnum + "-_", 20), lambda: base64.b64encode(r.bytes(int(r.integers(18, 40)))).decode(),
            lambda: pick(low_hex, r.integers(20, 48)), lambda: pick(low_hex.upper(), r.integers(20, 48)), lambda: "glpat-" + pick(alnum + "_-", 20), lambda: pick(alnum, r.integers(20, 44)),
            lambda: pick(string.ascii_letters, r.integers(18, 44)), lambda: pick(one(string.ascii_lowercase, string.ascii_uppercase), r.integers(20, 44)), lambda: "/" + pick(alnum + "+/", 40),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: one("password", "passwd", "secret", "token", "api_key", "apikey") + one("=", ": ", ' = "', ":") + pick(alnum, r.integers(12, 36)),
        )()

    def plain() -> str:
        return one(
            lambda: word(16, 30) + str(r.integers(10, 9999)), lambda: f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}.{r.integers(10, 60)}",
            lambda: f"{word()}.{word()}{r.integers(1, 99)}.{one('com', 'org', 'net', 'es')}/{word()}/{word()}", lambda: f"{word()}{r.integers(0, 99)}.{one('example', word(), word(4, 8))}.{one('com', 'org', 'net', 'de', 'fr')}", lambda: f"{word()}-{word()}-{word()}-{r.integers(1, 999)}",
            lambda: f"/{word()}/{word()}/{word()}_{r.integers(1, 99)}.{one('html', 'png', 'pdf')}", lambda: f"{word()}_{word()}_{word()}_{r.integers(0, 99)}", lambda: f"v{r.integers(1, 9)}.{r.integers(0, 99)}.{r.integers(0, 99)}-{word(8, 20)}",
            lambda: "=" * int(r.integers(8, 20)) + word() + str(r.integers(1, 9)), lambda: f"{r.integers(100, 999)}-{r.integers(100, 999)}-{r.integers(1000, 9999)}-{word()}", lambda: ("".join(word() for _ in range(3)) + str(r.integers(1, 99))).upper(),
            lambda: f"{word()}.{r.integers(1, 999)}...{word()}.{word()}", lambda: f"{word(10, 20)}={r.integers(1, 999)}",
            lambda: word(16, 28) + word(12, 24), lambda: (word(12, 20) + word(10, 20)).capitalize(), lambda: f"{word(6)}-{word(6)}-{word(8)}", lambda: f"{word(6)}.{word(6)}.{word(6)}/{word(6)}", lambda: f"{word(8)}_{word(8)}".upper(),
            lambda: one("-", "=", "_", ".") * int(r.integers(16, 60)), lambda: str(r.integers(10**17, 10**18)), lambda: word(8).capitalize() + word(8).capitalize() + word(8).capitalize(),
        )()

    found, labels = [], []
    for _ in range(rows):
        y = int(r.integers(2))
        body = secret() if y else plain()
        left = " ".join(word() for _ in range(r.integers(1, 5))) + one(" ", " ", "\n", ". ")
        if r.random() < (0.5 if y else 0.1):
            left += one("key", "token", "auth", "bearer", "credential", "pass", "id", "ref") + one(": ", " = ", "=", ' = "', " ")
        found.append((left + body + one(" ", '" ', ". ", "\n", ", ") + word(), len(left), len(left) + len(body)))
        labels.append(y)
    return found, np.array(labels, np.float32)


def train(rows: int = TRAIN_ROWS, seed: int = SEED, min_recall: float = MIN_RECALL) -> Network:
    """A network fitted on three quarters of the labelled findings and long runs, calibrated on the last."""
    found, y = labelled(rows, seed)
    runs, runs_y, places = long_runs(rows * LONG_ROWS // TRAIN_ROWS, seed)
    cut, runs_cut = rows * 3 // 4, len(runs) * 3 // 4
    frames, frames_y = long_frames(runs[:runs_cut], runs_y[:runs_cut], places[:runs_cut])
    net = Network(seed)
    net.fit(np.concatenate([np.stack([window(*f) for f in found[:cut]]), frames]), np.concatenate([y[:cut], frames_y]), seed=seed)
    net.calibrate(found[cut:] + runs[runs_cut:], np.concatenate([y[cut:], runs_y[runs_cut:]]), min_recall)
    return net


def scan(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and findings (kind, start, end, score) of every row; base findings are scored too."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                owners, spans, whole = [], [], []
                for i, t in enumerate(some.column("text").to_pylist()):
                    base = base_findings(t) if t else []
                    for f in [*base, *(Finding(a, b, "cnn") for a, b in candidates(t or "", base))]:
                        owners.append(i)
                        spans.append(f)
                        whole.append((t, f.start, f.end))
                scores = net.score_whole(whole)
                rows: list[list[dict]] = [[] for _ in range(some.num_rows)]
                for i, f, p in zip(owners, spans, scores):
                    if f.kind != "cnn" or net.is_secret(f.start, f.end, p):
                        rows[i].append({"kind": f.kind, "start": f.start, "end": f.end, "score": float(p)})
                for found in rows:
                    found.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, _FINDINGS)], ["doc_id", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, findings array<struct<kind:string,start:long,end:long,score:double>>")


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs, train())
    base = F.filter("findings", lambda f: f["kind"] != "cnn")
    spell = lambda fs: F.concat_ws(",", F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    scores = F.concat_ws(",", F.transform("findings", lambda f: F.format_string("%.3f", f["score"])))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("findings")).alias("spans"), count("cnn").alias("n_cnn"), scores.alias("scores"))


def redact(docs: DataFrame, net: Network | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every finding replaced by ``[kind]``; all rows and columns stay, null text too."""
    net = net or train()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for start in range(0, batch.num_rows, BATCH):
                texts = batch.column(at).slice(start, BATCH).to_pylist()
                found = [base_findings(t) if t else [] for t in texts]
                more = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t, found[i])]
                scores = net.score_whole([(texts[i], a, b) for i, a, b in more])
                for (i, a, b), p in zip(more, scores):
                    if net.is_secret(a, b, p):
                        found[i].append(Finding(a, b, "cnn"))
                out += [_without(t, f) for t, f in zip(texts, found)]
            yield batch.set_column(at, text, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def stage(docs: DataFrame) -> DataFrame:
    """All documents, without their secrets and with ``n_chars``, if they have it, set anew."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def _without(text: str | None, found: list[Finding]) -> str | None:
    if not found:
        return text
    parts, last = [], 0
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if f.start >= last:
            parts += [text[last : f.start], f"[{f.kind}]"]
        elif f.end <= last:
            continue
        last = max(last, f.end)
    return "".join(parts) + text[last:]
