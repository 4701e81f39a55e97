"""Personal data: given patterns, and a character BiLSTM with a CRF that finds more of the kind.

The patterns of the contract label spans in the texts. A bidirectional LSTM over characters
with CRF transitions is trained in numpy on a bounded sample of windows around them, half of
them written differently (separators, a missing plus sign, blanks around @). Every text is
then read in overlapping windows around each digit and @, since none of the kinds does without;
windows are decoded by Viterbi and reconciled over the text: a character has the label of
the window in which it lies most central. Spans that touch no pattern match are added.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import whole

#: fixed by the contract: kinds in order
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
#: digits a span the model adds must have, at least and at most
MODEL_DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (14, 19), "phone": (9, 15)}

WIDTH, MARGIN = 64, 24
LABELS = 1 + 2 * len(KINDS)
SYMBOLS = 100
EMBEDDING, HIDDEN = 12, 16
TRAIN_WINDOWS, STEPS, BATCH, RATE = 2000, 400, 64, 0.02
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@... finds them leftmost, in linear time: a match holds one @ and the
    whole run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at)  # the next run can't reach over this @
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for found in DOTTED.finditer(text):
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", found.group())] if found.group().count(".") > 2 else []
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            values = [found.group()[a:b].lstrip("0") for a, b in four]
            if all(len(v) < 4 and int(v or 0) < 256 for v in values):
                yield found.start() + four[0][0], found.start() + four[3][1]


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The contract's matches, by start and then kind; code points, end exclusive."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if SEED.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        for found in DIGITS.finditer(text):
            digits = _only_digits(found.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", found.start(), found.end()))
        for found in PHONE.finditer(text):
            if 10 <= len(_only_digits(found.group())) <= 15:
                out.append(("phone", found.start(), found.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def windows(text: str, width: int = WIDTH, margin: int = MARGIN) -> list[int]:
    """Starts of the windows that cover `margin` characters around every digit and @.

    Neighbouring windows overlap by half.
    """
    regions: list[list[int]] = []
    for found in SEED.finditer(text):
        a, b = max(0, found.start() - margin), min(len(text), found.end() + margin)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        starts = list(range(a, max(a + 1, b - width // 2), width // 2))
        out += starts if not out or starts[0] > out[-1] else [s for s in starts if s > out[-1]]
    return out


def codes(text: str) -> np.ndarray:
    """Printable ASCII 1 to 95, other letters 96, line ends 97, other characters 98; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.where((points >= 32) & (points < 127), points - 31, 98).astype(np.int64)
    out[points == 10] = 97
    for i in np.flatnonzero(points > 127):
        if text[i].isalpha():
            out[i] = 96
    return out


def encode_windows(text: str, starts: list[int], width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(starts), width), dtype=np.int64)
    for r, a in enumerate(starts):
        c = codes(text[a : a + width])
        out[r, : len(c)] = c
    return out


def labels(n: int, spans: list[Span]) -> np.ndarray:
    """0 outside; 1 + 2k at the first character of kind k, 2 + 2k inside. Earlier spans win."""
    out = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def rewritten(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """The text with its spans written in another way, and the spans' new places."""
    out, to, moved = [], 0, []
    for kind, a, b in spans:
        if a < to:
            continue
        old = text[a:b]
        if kind == "email":
            new = old.replace("@", " @ " if turn % 2 else "@")
        elif kind == "phone":
            new = old.lstrip("+") if turn % 2 else re.sub("[ .-]", "/", old)
        elif kind == "card":
            new = re.sub("[ -]", "", old) if turn % 2 else ".".join(re.findall(".{1,4}", _only_digits(old)))
        else:
            new = old.replace(".", " . ") if turn % 2 else old
        out.append(text[to:a])
        start = sum(map(len, out))
        out.append(new)
        moved.append((kind, start, start + len(new)))
        to = b
    return "".join(out) + text[to:], moved


@dataclass
class Model:
    """Parameters of the network; f and b are the two directions."""

    embed: np.ndarray
    fx: np.ndarray
    fh: np.ndarray
    fb: np.ndarray
    bx: np.ndarray
    bh: np.ndarray
    bb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    step: np.ndarray

    @staticmethod
    def new(seed: int = 0) -> Model:
        r = np.random.default_rng(seed)
        d, h, k = EMBEDDING, HIDDEN, LABELS

        def draw(*shape):
            return r.normal(0, 1 / np.sqrt(shape[0]), shape)

        forget = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # gates: in, forget, out, new
        return Model(draw(SYMBOLS, d), draw(d, 4 * h), draw(h, 4 * h), forget, draw(d, 4 * h), draw(h, 4 * h), forget.copy(),
                     draw(2 * h, k), np.zeros(k), np.zeros((k, k)))

    def arrays(self) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, wx, wh, b, keep: bool = False):
    """States of one direction for inputs (batch, time, size)."""
    n, t, _ = x.shape
    size = len(wh)
    gates = x @ wx + b
    h, c = np.zeros((n, size)), np.zeros((n, size))
    states, cells, acts = np.empty((n, t, size)), [], []
    for i in range(t):
        z = gates[:, i] + h @ wh
        s, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        before = c
        c = s[:, size : 2 * size] * c + s[:, :size] * g
        tc = np.tanh(c)
        h = s[:, 2 * size :] * tc
        states[:, i] = h
        if keep:
            acts.append((s, g, before, tc))
    return states, acts


def _lstm_back(x, wx, wh, states, acts, grad):
    n, t, size = states.shape
    dz = np.empty((n, t, 4 * size))
    dh, dc = np.zeros((n, size)), np.zeros((n, size))
    for i in reversed(range(t)):
        s, g, before, tc = acts[i]
        a, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        dh = dh + grad[:, i]
        dc = dc + dh * o * (1 - tc**2)
        dz[:, i] = np.concatenate([dc * g * a * (1 - a), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g**2)], axis=1)
        dh, dc = dz[:, i] @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    last = np.concatenate([np.zeros((n, 1, size)), states[:, :-1]], axis=1).reshape(-1, size)
    return x.reshape(-1, x.shape[2]).T @ flat, last.T @ flat, flat.sum(axis=0), dz @ wx.T


def emissions(m: Model, x: np.ndarray) -> np.ndarray:
    e = m.embed[x]
    f, _ = _lstm(e, m.fx, m.fh, m.fb)
    b, _ = _lstm(e[:, ::-1], m.bx, m.bh, m.bb)
    return np.concatenate([f, b[:, ::-1]], axis=2) @ m.out + m.bias


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the label sequences, and its gradients."""
    n, t = x.shape
    e = m.embed[x]
    f, fa = _lstm(e, m.fx, m.fh, m.fb, True)
    back = np.ascontiguousarray(e[:, ::-1])
    b, ba = _lstm(back, m.bx, m.bh, m.bb, True)
    h = np.concatenate([f, b[:, ::-1]], axis=2)
    scores = h @ m.out + m.bias
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for i in range(1, t):
        alpha[:, i] = scores[:, i] + _logsum(alpha[:, i - 1][:, :, None] + m.step, 1)
    for i in reversed(range(t - 1)):
        beta[:, i] = _logsum(m.step + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    total = _logsum(alpha[:, -1], 1)
    rows = np.arange(n)[:, None]
    path = scores[rows, np.arange(t), y].sum() + m.step[y[:, :-1], y[:, 1:]].sum()
    d_scores = np.exp(alpha + beta - total[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + m.step + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
    d_step = pairs.sum(axis=(0, 1))
    np.subtract.at(d_step, (y[:, :-1], y[:, 1:]), 1)
    d_scores[rows, np.arange(t), y] -= 1
    dh = d_scores @ m.out.T
    size = len(m.fh)
    g_fx, g_fh, g_fb, de = _lstm_back(e, m.fx, m.fh, f, fa, dh[:, :, :size])
    g_bx, g_bh, g_bb, db = _lstm_back(back, m.bx, m.bh, b, ba, dh[:, ::-1, size:])
    de = de + db[:, ::-1]
    g_embed = np.zeros_like(m.embed)
    np.add.at(g_embed, x, de)
    found = {"embed": g_embed, "fx": g_fx, "fh": g_fh, "fb": g_fb, "bx": g_bx, "bh": g_bh, "bb": g_bb,
             "out": h.reshape(-1, 2 * size).T @ d_scores.reshape(-1, LABELS), "bias": d_scores.sum(axis=(0, 1)), "step": d_step}
    return float(total.sum() - path) / n, {k: v / n for k, v in found.items()}


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 0) -> Model:
    """Adam over `steps` shuffled batches; the same rows give the same model."""
    m, r = Model.new(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.arrays().items()} for _ in range(2))
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = r.permutation(len(x))
        rows, order = order[:BATCH], order[BATCH:]
        _, grads = loss_and_gradients(m, x[rows], y[rows])
        rate = RATE * (1 - step / steps) + 0.001
        for k, v in m.arrays().items():
            g = np.clip(grads[k], -5, 5)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def decode(m: Model, x: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The likeliest labels of each window."""
    out = np.zeros(x.shape, dtype=np.int64)
    for at in range(0, len(x), rows):
        scores = emissions(m, x[at : at + rows])
        n, t, k = scores.shape
        best, came = scores[:, 0], np.empty((n, t, k), dtype=np.int64)
        for i in range(1, t):
            ways = best[:, :, None] + m.step
            came[:, i] = ways.argmax(axis=1)
            best = scores[:, i] + np.take_along_axis(ways, came[:, i][:, None, :], 1)[:, 0]
        label = best.argmax(axis=1)
        for i in reversed(range(t)):
            out[at : at + rows, i] = label
            if i:
                label = came[np.arange(n), i, label]
    return out


def reconciled(n: int, starts: list[int], found: np.ndarray) -> np.ndarray:
    """One label for each of n characters: that of the window in which it is most central."""
    width = found.shape[1] if len(found) else WIDTH
    depth = np.minimum(np.arange(width), np.arange(width)[::-1]) + 1
    out, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for a, row in zip(starts, found):
        b = min(n, a + width)
        # at the text's own ends a window is not cut
        d = depth[: b - a].copy()
        d[: width // 2] += (a == 0) * width
        d[max(0, b - a - width // 2) :] += (b == n) * width
        deeper = d > best[a:b]
        out[a:b][deeper], best[a:b][deeper] = row[: b - a][deeper], d[deeper]
    return out


def model_spans(text: str, found: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of one kind that touch no base span and hold as many digits as their kind has."""
    out, i, n = [], 0, len(found)
    kind = (found + 1) // 2  # 0 outside
    marked = np.flatnonzero(kind)
    while len(marked):
        i = int(marked[0])
        j = i + 1
        while j < n and found[j] == 2 * kind[i]:
            j += 1
        name = KINDS[kind[i] - 1]
        least, most = MODEL_DIGITS[name]
        part = text[i:j]
        lead = len(part) - len(part.lstrip(" ,;:\n"))
        a, b = i + lead, i + len(part.rstrip(" .,;:\n"))
        shaped = {"email": "@" in part.strip("@ "), "ip": part.count(".") > 2}.get(name, True)
        fits = least <= len(_only_digits(part)) <= most and shaped
        if b > a and fits and not any(s < b and a < e for _, s, e in base):
            out.append((name, a, b))
        marked = marked[np.searchsorted(marked, j) :]
    return out


def _find(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if sent is None else Model(**sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            starts = [windows(t) if m is not None else [] for t in texts]
            extra: list[list[Span]] = [[] for _ in texts]
            some = [i for i, s in enumerate(starts) if s]
            if some:
                every = np.concatenate([encode_windows(texts[i], starts[i]) for i in some])
                found, at = decode(m, every), 0
                for i in some:
                    own = found[at : at + len(starts[i])]
                    at += len(starts[i])
                    extra[i] = model_spans(texts[i], reconciled(len(texts[i]), starts[i], own), base[i])
            spans = [sorted(b + e, key=lambda s: (s[1], KINDS.index(s[0]))) for b, e in zip(base, extra)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                + [pa.array([joined(b) for b in base]), pa.array([joined(s) for s in spans])],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the texts with the base spans that lie wholly inside."""
    for batch in batches:
        out: dict[str, list] = {"text": [], "spans": [], "marked": []}
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for a in windows(text):
                b = a + WIDTH
                inside = [s for s in base if a <= s[1] and s[2] <= b]
                if any(s[1] < b and a < s[2] for s in base if s not in inside):
                    continue  # a span is cut here, and whole in the next window
                out["text"].append(text[a:b])
                out["spans"].append(joined([(k, s - a, e - a) for k, s, e in inside]))
                out["marked"].append(inside[0][0] if inside else "none")
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})


def parsed(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def examples(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of windows as (text, spans), each second one with spans written anew."""
    x, y = [], []
    for turn, (text, spans) in enumerate(rows):
        s = parsed(spans)
        if s and turn % 2:
            text, s = rewritten(text, s, turn // 2)
        text, s = text[:WIDTH], [v for v in s if v[2] <= WIDTH]
        x.append(encode_windows(text, [0])[0])
        y.append(np.pad(labels(len(text), s), (0, WIDTH - len(text))))
    return np.array(x), np.array(y)


def training_windows(texts: DataFrame, most: int = TRAIN_WINDOWS) -> list[tuple[str, str]]:
    """At most `most` windows, as many of each kind and without a span, by a hash of the window.

    They are a few hundred characters each, so their number bounds what the driver holds.
    """
    found = texts.where(F.col("text").rlike("[0-9@]")).mapInArrow(_windows, "text string, spans string, marked string")
    picked = []
    for kind in ("none", *KINDS):
        own = found.where(F.col("marked") == kind)
        picked.append(own.orderBy(F.xxhash64("text"), "text").limit(most // (1 + len(KINDS))))
    every = picked[0]
    for p in picked[1:]:
        every = every.unionByName(p)
    return sorted((r["text"], r["spans"]) for r in every.collect())


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans.

    base and spans are kind:start:end, comma-joined; spans holds the base spans and those the
    model adds. Null texts are empty and have none. Without labelled windows there is no model
    and nothing is added. Rows with the same or no doc_id stay apart; other columns are not read.
    """
    t = whole(f"`{text}`")
    rows = training_windows(docs.select(t.alias("text")), train_windows)
    sent = None
    if any(s for _, s in rows):
        order = np.random.default_rng(1).permutation(len(rows))
        x, y = examples([rows[i] for i in order])
        sent = docs.sparkSession.sparkContext.broadcast(train(x, y, steps).arrays())
    # texts without a digit and an @ hold nothing to look for and stay behind
    looked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.when(t.rlike("[0-9@]"), t).otherwise(F.lit("")).alias("text"))
    kind = looked.schema["doc_id"].dataType.simpleString()
    return looked.mapInArrow(_find(sent), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
