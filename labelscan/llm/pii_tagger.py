"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns give the base spans. The model is trained in numpy on windows around the triggers (digits and @)
of a bounded sample, labelled with the base spans, and adds spans that the patterns miss. Every span of every
kind holds a digit or an @, so windows without one cannot give a span and are not decoded; all others are, over
whole texts. Windows overlap; each character takes its label from the window in which it lies most central, and
spans are read from the labels of the whole text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick, text_place

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and between windows; characters kept on both sides of a trigger.
WIDTH, STRIDE, MARGIN = 48, 24, 20
#: Windows that the model is trained on (those with the smallest hashes), passes over them, sizes of the model.
TRAIN_WINDOWS, EPOCHS, EMBED, HIDDEN, BATCH = 3000, 8, 12, 16, 64
#: Shortest span that the model may add.
LEAST = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and then kind."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    if _TRIGGER.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the stretches around the triggers."""
    out = []
    stretch: list[int] | None = None
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if stretch and a <= stretch[1]:
            stretch[1] = b
        else:
            if stretch:
                out += _cover(*stretch)
            stretch = [a, b]
    return out + (_cover(*stretch) if stretch else [])


def _cover(a: int, b: int) -> list[tuple[int, int]]:
    starts = range(a, max(a + 1, b - WIDTH + STRIDE), STRIDE)
    return [(s, min(s + WIDTH, b)) for s in starts]


def characters(text: str) -> np.ndarray:
    """Numbers of the characters: 0 padding, 1 other, 2 other letter, then ASCII."""
    cps = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.where((cps >= 32) & (cps < 127), cps - 32 + 3, 1)
    if (cps > 127).any():
        out[[i for i in np.flatnonzero(cps > 127).tolist() if text[i].isalpha()]] = 2
    return out


SYMBOLS, TAGS = 3 + 95, 1 + 2 * len(KINDS)


def tags_of(text: str, spans: list[tuple[int, int, str]], start: int, end: int) -> np.ndarray:
    """Labels of a window: 0 outside, 1 + 2k the first and 2 + 2k the further characters of a span of kind k."""
    out = np.zeros(WIDTH, np.int64)
    for a, b, kind in spans:
        if a < end and b > start:
            k = KINDS.index(kind)
            out[max(a - start, 0) : b - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    out[end - start :] = 0
    return out


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions, with their gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        size = EMBED + HIDDEN
        self.p = {
            "e": r.normal(0, 0.3, (SYMBOLS, EMBED)), "f": r.normal(0, size**-0.5, (size, 4 * HIDDEN)), "fb": np.zeros(4 * HIDDEN),
            "r": r.normal(0, size**-0.5, (size, 4 * HIDDEN)), "rb": np.zeros(4 * HIDDEN), "o": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "ob": np.zeros(TAGS),
            "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS),
        }
        self.trained = False
        self.p["fb"][HIDDEN : 2 * HIDDEN] = self.p["rb"][HIDDEN : 2 * HIDDEN] = 1.0

    @staticmethod
    def _lstm(x, w, b, keep=False):
        """Hidden states (time, batch, HIDDEN) of inputs (time, batch, EMBED)."""
        steps, n = x.shape[:2]
        xw = x @ w[:EMBED] + b
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out, memory = np.empty((steps, n, HIDDEN), x.dtype), []
        for t in range(steps):
            z = xw[t] + h @ w[EMBED:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                memory.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, memory

    @staticmethod
    def _lstm_back(x, w, memory, dh_all):
        dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros_like(x)
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in range(len(memory) - 1, -1, -1):
            h, before, i, f, o, g, tc = memory[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dw[:EMBED] += x[t].T @ dz
            dw[EMBED:] += h.T @ dz
            db += dz.sum(axis=0)
            dx[t] = dz @ w[:EMBED].T
            dh, dc = dz @ w[EMBED:].T, dc * f
        return dw, db, dx

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """Scores (time, batch, TAGS) of windows (batch, time)."""
        p = self.p
        x = p["e"][chars.T]
        a, ma = self._lstm(x, p["f"], p["fb"], keep)
        b, mb = self._lstm(x[::-1], p["r"], p["rb"], keep)
        h = np.concatenate([a, b[::-1]], axis=2)
        return h @ p["o"] + p["ob"], (x, ma, mb, h)

    @staticmethod
    def _lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradients."""
        p = self.p
        em, (x, ma, mb, h) = self.emissions(chars, True)
        steps, n, _ = em.shape
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = p["s"] + em[0]
        for t in range(1, steps):
            alpha[t] = self._lse(alpha[t - 1][:, :, None] + p["t"][None], 1) + em[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = self._lse(p["t"][None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = self._lse(alpha[-1], 1)
        rows = np.arange(n)
        score = p["s"][tags[:, 0]] + em[0, rows, tags[:, 0]]
        d_t = np.zeros_like(p["t"])
        d_em = np.exp(alpha + beta - z[None, :, None])
        d_s = d_em[0].sum(axis=0)
        np.subtract.at(d_s, tags[:, 0], 1)
        for t in range(steps):
            d_em[t, rows, tags[:, t]] -= 1
            if t:
                score = score + p["t"][tags[:, t - 1], tags[:, t]] + em[t, rows, tags[:, t]]
                both = np.exp(alpha[t - 1][:, :, None] + p["t"][None] + (em[t] + beta[t])[:, None, :] - z[:, None, None])
                d_t += both.sum(axis=0)
                np.subtract.at(d_t, (tags[:, t - 1], tags[:, t]), 1)
        d_em /= n
        g = {"t": d_t / n, "s": d_s / n, "o": np.einsum("tbh,tbk->hk", h, d_em), "ob": d_em.sum(axis=(0, 1))}
        dh = d_em @ p["o"].T
        g["f"], g["fb"], dx = self._lstm_back(x, p["f"], ma, dh[:, :, :HIDDEN])
        g["r"], g["rb"], dr = self._lstm_back(x[::-1], p["r"], mb, dh[::-1, :, HIDDEN:])
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], chars.T, dx + dr[::-1])
        return float((z - score).mean()), g

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Mean loss of each epoch; Adam steps over shuffled batches."""
        r = np.random.default_rng(seed)
        m, v = ({x: np.zeros_like(y) for x, y in self.p.items()} for _ in range(2))
        k, losses = 0, []
        for epoch in range(epochs):
            order, total = r.permutation(len(chars)), []
            for i in range(0, len(order), BATCH):
                loss, g = self.gradients(chars[order[i : i + BATCH]], tags[order[i : i + BATCH]])
                total.append(loss)
                k += 1
                rate = 0.02 * 0.75**epoch
                for x in self.p:
                    m[x] += 0.1 * (g[x] - m[x])
                    v[x] += 0.001 * (g[x] ** 2 - v[x])
                    self.p[x] -= rate * (m[x] / (1 - 0.9**k)) / (np.sqrt(v[x] / (1 - 0.999**k)) + 1e-8)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best label sequence of each window."""
        em, _ = self.emissions(chars)
        steps, n, _ = em.shape
        best, back = self.p["s"] + em[0], np.empty(em.shape, np.int64)
        for t in range(1, steps):
            step = best[:, :, None] + self.p["t"][None]
            back[t] = step.argmax(axis=1)
            best = np.take_along_axis(step, back[t][:, None, :], 1)[:, 0] + em[t]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def spans(self, texts: list[str], batch: int = 1024) -> list[list[tuple[int, int, str]]]:
        """Spans of each whole text by the model alone."""
        cuts = [windows(t) for t in texts]
        flat = [(i, a, b) for i, found in enumerate(cuts) for a, b in found]
        labels = [dict[int, tuple[float, int]]() for _ in texts]
        for k in range(0, len(flat), batch):
            part = flat[k : k + batch]
            chars = np.zeros((len(part), WIDTH), np.int64)
            for row, (i, a, b) in enumerate(part):
                chars[row, : b - a] = characters(texts[i][a:b])
            for (i, a, b), tags in zip(part, self.decode(chars), strict=True):
                for j, tag in enumerate(tags[: b - a].tolist()):
                    far = abs(j - (WIDTH - 1) / 2)
                    if a + j not in labels[i] or far < labels[i][a + j][0]:
                        labels[i][a + j] = (far, tag)
        return [_read(text, found) for text, found in zip(texts, labels, strict=True)]


def _read(text: str, labels: dict[int, tuple[float, int]]) -> list[tuple[int, int, str]]:
    """Spans of the reconciled labels of one text."""
    out, start, kind, last = [], 0, -1, -2
    for i in [*sorted(labels), len(text) + 1]:
        tag = labels[i][1] if i in labels else 0
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or i != last + 1 or tag % 2):
            if last + 1 - start >= LEAST and _TRIGGER.search(text, start, last + 1):
                out.append((start, last + 1, KINDS[kind]))
            kind = -1
        if now >= 0 and kind < 0:
            start, kind = i, now
        last = i
    return out


def all_spans(text: str, model: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those of the model that touch none of them."""
    added = [m for m in model if all(m[1] <= b[0] or m[0] >= b[1] for b in base)]
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def _examples(batches):
    for batch in batches:
        keys, chars, tags = [], [], []
        for text in batch.column(0).to_pylist():
            if text and _TRIGGER.search(text):
                spans = base_spans(text)
                for a, b in windows(text):
                    padded = np.zeros(WIDTH, np.int64)
                    padded[: b - a] = characters(text[a:b])
                    keys.append(hashlib.blake2b(text[a:b].encode(), digest_size=8).hexdigest())
                    chars.append(padded.tolist())
                    tags.append(tags_of(text, spans, a, b).tolist())
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(chars, kind), pa.array(tags, kind)], names=["key", "chars", "tags"])


def train(docs: DataFrame, sample: int = TRAIN_WINDOWS) -> Tagger:
    """The model, from at most ``sample`` windows of ``docs``; without windows it stays untrained and is not used."""
    found = pick(docs, text="string").mapInArrow(_examples, "key string, chars array<int>, tags array<int>")
    rows = found.orderBy("key", "chars", "tags").limit(sample).collect()
    model = Tagger()
    model.trained = bool(rows)
    if rows:
        model.train(np.array([r.chars for r in rows]), np.array([r.tags for r in rows]))
        model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def _judged(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    base = [base_spans(t) for t in texts]
    more = model.spans(texts) if model.trained else [[]] * len(texts)
    return [(b, all_spans(t, m, b)) for t, m, b in zip(texts, more, base, strict=True)]


def _written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame, sample: int = TRAIN_WINDOWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Places are code points, ends exclusive. Repeated rows are judged row by
    row; an empty table gives no rows.
    """
    model = train(docs, sample)

    def run(batches):
        for batch in batches:
            found = _judged([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[2] == kind for s in b) for b, _ in found], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_written(s) for _, s in found], pa.string())], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, sample: int = TRAIN_WINDOWS) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, and n_chars counted anew, if present.

    All columns stay, clashing names included; the text is the column of exactly that name, else one that differs
    in case. Null texts stay null, repeated rows are redacted row by row, an empty table gives no rows. Spans that
    overlap are replaced as one, under the first one's kind.
    """
    model = train(docs, sample)
    at = text_place(docs.columns)
    # columns by position: their names may clash
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, _judged([t or "" for t in texts], model), strict=True):
                if spans:
                    parts, done = [], 0
                    for a, b, kind in spans:
                        if a >= done:
                            parts += [text[done:a], f"<{kind.upper()}>"]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    changed = flat.mapInArrow(run, flat.schema)
    if "n_chars" in docs.columns:
        n = docs.columns.index("n_chars")
        changed = changed.withColumn(f"c{n}", F.length(f"c{at}").cast(flat.schema[n].dataType))
    return changed.toDF(*docs.columns)

