"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained here in numpy.

The model learns from labelled spans (generated ones: personal data of many forms in running text, beside look-alikes
such as versions, dates, hashes, licence numbers). Every span of the four kinds holds a digit or "@", so windows are
laid around those characters, wherever they are in a text; windows overlap, and what they decode is reconciled for the
whole text: a character's label comes from the window in which it lies farthest from an edge. Pattern spans always
stay; a model span is added where it touches none of them, has the shape that its kind needs and a high posterior.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", re.ASCII)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+", re.ASCII)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.ASCII)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.ASCII)

MARK = re.compile(r"[0-9@]", re.ASCII)
WINDOW, MARGIN = 96, 24
#: Characters of a name before "@" that a window holds: an address has no more.
NAME = 65
HIDDEN, EMBED = 24, 12
TRAIN_TEXTS, TRAIN_EPOCHS, SEED = 2_048, 12, 11
#: Characters of a text to learn from, at least.
TRAINED = 40
#: Least posterior of every character of a model span.
SURE = 0.6

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255? Digits may be any number of ASCII ones."""
    return digits.isascii() and digits.isdigit() and len(s := digits.lstrip("0")) <= 3 and int(s or "0") <= 255


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start. Matches are leftmost and don't overlap within a kind; those that fail the kind's test go."""
    if not MARK.search(text):
        return []
    out = _emails(text) if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# --- labelled spans to learn from ---------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice(("an", "er", "th", "ion", "que", "de", "sch", "ar", "os", "in", "li", "é", "ü", "st", "re", "ha")) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((13, 14, 14, 14)))
    body += next(c for c in "0123456789" if luhn(body + c))
    sep = r.choice(("", "", " ", "-"))
    return sep.join(body[i : i + 4] for i in range(0, len(body), 4)) if sep else body


def _private(r: random.Random) -> tuple[str, int]:
    kind = r.randrange(4)
    if kind == 0:
        at, dot = r.choice((("@", "."),) * 6 + ((" @ ", "."), ("@", " . ")))
        name = r.choice((f"{_word(r)}.{_digits(r, 2)}", _word(r), f"{_word(r)}_{_word(r)}", f"{_word(r)}{_digits(r, 3)}")).encode("ascii", "ignore").decode() or "me"
        return f"{name}{at}{r.choice(('mail', 'host', 'post'))}{r.choice(('', _digits(r, 1)))}{dot}{r.choice(('example', 'site', 'corp'))}{dot}{r.choice(('com', 'org', 'net', 'de'))}", 0
    if kind == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), 1
    if kind == 2:
        return _card(r), 2
    country, a, b, c = r.choice(("+1", "+44", "+49", "+33", "001", "0049")), _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"{country} ({a}) {b}-{c}", f"{country} {a} {b} {c}", f"{country}-{a}-{b}-{c}", f"{country}{a}{b}{c}", f"({a}) {b}-{c}")), 3


def _alike(r: random.Random) -> str:
    return r.choice(
        (
            f"Version {_digits(r, 1)}.{_digits(r, 1)}", f"v{_digits(r, 1)}.{_digits(r, 2)}.{_digits(r, 1)}", f"{r.randint(1900, 2030)}", f"{r.randint(1990, 2030)}-{_digits(r, 2)}-{_digits(r, 2)}",
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 32, 40)))), "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)),
            f"{_digits(r, 2)}.{_digits(r, 2)}", f"{_digits(r, 1)},{_digits(r, 3)}", f"{r.randint(300, 999)}.{r.randint(300, 999)}.{_digits(r, 3)}.{_digits(r, 4)}", _digits(r, r.choice((2, 4, 5, 6, 8, 20, 24))),
            f"@{_word(r)}", f"{_word(r)} @ {_digits(r, 2)}", f"password={_digits(r, 6)}{_word(r)}", f"CC BY-NC {_digits(r, 1)}.0", f"#{_digits(r, 5)}", f"page={_digits(r, 2)}&ref={_word(r)}",
        )
    )


def labelled(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts of TRAINED characters or a few more with their spans."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < TRAINED:
            x = r.random()
            if x < 0.16:
                s, kind = _private(r)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            elif x < 0.32:
                text += _alike(r)
            else:
                text += r.choice((_word(r), _word(r).capitalize(), _word(r).upper()))
            text += r.choice((" ",) * 8 + (". ", ", ", "\n", "; "))
        out.append((text, spans))
    return out


# --- the model ----------------------------------------------------------------------------------------------------

#: Characters told apart; all others fall into a few classes.
ALPHABET = {c: i + 8 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz@.+-_%() ,:;=/#&\n")}
CLASSES = 8 + len(ALPHABET)
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def codes(text: str) -> np.ndarray:
    """Class of each character: 0 padding, 1 digit, 2 upper case, 3 other letter, 4 the rest; 8 on: ALPHABET."""
    return np.array([1 if c in "0123456789" else ALPHABET.get(c) or (2 if c.isupper() else 3 if c.isalpha() else 4) for c in text], np.int64)


def tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, a, b in spans:
        out[a:b] = 2 + 2 * k
        if a < n:
            out[a] = 1 + 2 * k
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(p: dict, d: str, x: np.ndarray, mask: np.ndarray):
    """x: (time, batch, EMBED). Hidden states, and what the backward pass needs."""
    T, B, _ = x.shape
    h, c = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
    xs = x @ p[f"{d}W"] + p[f"{d}b"]
    hs, kept = np.empty((T, B, HIDDEN), np.float32), []
    for t in range(T):
        a = xs[t] + h @ p[f"{d}U"]
        i, f, o, g = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = (f * c + i * g) * m
        tc = np.tanh(new_c)
        new_h = o * tc * m
        kept.append((h, c, i, f, o, g, tc, m))
        h, c = new_h, new_c
        hs[t] = h
    return hs, kept


def _lstm_back(p: dict, grad: dict, d: str, x: np.ndarray, kept, dhs: np.ndarray) -> np.ndarray:
    dh, dc, dx = np.zeros_like(dhs[0]), np.zeros_like(dhs[0]), np.empty_like(x)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh_ = (dhs[t] + dh) * m
        dc_ = (dc + dh_ * o * (1 - tc * tc)) * m
        da = np.concatenate([dc_ * g * i * (1 - i), dc_ * c * f * (1 - f), dh_ * tc * o * (1 - o), dc_ * i * (1 - g * g)], 1)
        grad[f"{d}W"] += x[t].T @ da
        grad[f"{d}U"] += h.T @ da
        grad[f"{d}b"] += da.sum(0)
        dx[t], dh, dc = da @ p[f"{d}W"].T, da @ p[f"{d}U"].T, dc_ * f
    return dx


def _scores(p: dict, ids: np.ndarray, mask: np.ndarray):
    """Emission scores (time, batch, TAGS). ids: (time, batch)."""
    x = p["E"][ids]
    fw, kf = _lstm(p, "f", x, mask)
    bw, kb = _lstm(p, "r", x[::-1], mask[::-1])
    h = np.concatenate([fw, bw[::-1]], 2)
    return h @ p["V"] + p["v"], (x, h, kf, kb)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _forward(s, A, mask):
    out = [s[0]]
    for t in range(1, len(s)):
        new = _lse(out[-1][:, :, None] + A[None], 1) + s[t]
        out.append(np.where(mask[t][:, None] > 0, new, out[-1]))
    return out


def _backward(s, A, mask):
    out = [np.zeros_like(s[0])]
    for t in range(len(s) - 1, 0, -1):
        new = _lse((s[t] + out[-1])[:, None, :] + A[None], 2)
        out.append(np.where(mask[t][:, None] > 0, new, out[-1]))
    return out[::-1]


def marginals(p: dict, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Posterior of each tag at each character, under the CRF."""
    s, _ = _scores(p, ids, mask)
    f, b = _forward(s, p["A"], mask), _backward(s, p["A"], mask)
    z = _lse(f[-1], 1)
    return np.stack([np.exp(f[t] + b[t] - z[:, None]) for t in range(len(s))])


def viterbi(p: dict, s: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The best tag sequence of each window, (time, batch)."""
    best, back = s[0], []
    for t in range(1, len(s)):
        x = best[:, :, None] + p["A"][None]
        at = x.argmax(1)
        new = np.take_along_axis(x, at[:, None, :], 1)[:, 0] + s[t]
        m = mask[t][:, None] > 0
        back.append(np.where(m, at, np.arange(TAGS)[None]))
        best = np.where(m, new, best)
    out = [best.argmax(1)]
    for at in reversed(back):
        out.append(np.take_along_axis(at, out[-1][:, None], 1)[:, 0])
    return np.stack(out[::-1])


def initial(seed: int = SEED) -> dict:
    r = np.random.default_rng(seed)
    g = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    p = {"E": g(CLASSES, EMBED) * 3, "V": g(2 * HIDDEN, TAGS), "v": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fr":
        p |= {f"{d}W": g(EMBED, 4 * HIDDEN), f"{d}U": g(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
        p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1
    return p


def gradient(p: dict, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood for each text under the CRF, and its gradient."""
    T, B = ids.shape
    s, (x, h, kf, kb) = _scores(p, ids, mask)
    f, b = _forward(s, p["A"], mask), _backward(s, p["A"], mask)
    z = _lse(f[-1], 1)
    cols = np.arange(B)
    gold = s[0, cols, y[0]] * mask[0]
    ds, dA = np.zeros_like(s), np.zeros_like(p["A"])
    for t in range(T):
        ds[t] = np.exp(f[t] + b[t] - z[:, None]) * mask[t][:, None]
        ds[t, cols, y[t]] -= mask[t]
        if t:
            gold = gold + (s[t, cols, y[t]] + p["A"][y[t - 1], y[t]]) * mask[t]
            dA += (np.exp(f[t - 1][:, :, None] + p["A"][None] + (s[t] + b[t] - z[:, None])[:, None, :]) * mask[t][:, None, None]).sum(0)
            np.subtract.at(dA, (y[t - 1], y[t]), mask[t])
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["A"] = dA
    grad["V"] = np.einsum("tbh,tbk->hk", h, ds)
    grad["v"] = ds.sum((0, 1))
    dh = ds @ p["V"].T
    dx = _lstm_back(p, grad, "f", x, kf, dh[:, :, :HIDDEN])
    dx = dx + _lstm_back(p, grad, "r", x[::-1], kb, dh[::-1, :, HIDDEN:])[::-1]
    np.add.at(grad["E"], ids, dx)
    return float((z - gold).sum() / B), {k: (v / B).astype(np.float32) for k, v in grad.items()}


def batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    T = max(map(len, texts))
    ids, mask = np.zeros((T, len(texts)), np.int64), np.zeros((T, len(texts)), np.float32)
    for k, t in enumerate(texts):
        ids[: len(t), k], mask[: len(t), k] = codes(t), 1
    return ids, mask


def train(n: int = TRAIN_TEXTS, epochs: int = TRAIN_EPOCHS, seed: int = SEED, size: int = 32) -> dict:
    """Adam over the labelled texts. The same seed gives the same model."""
    data, p = labelled(n, seed), initial(seed)
    m, v, step, r = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, np.random.default_rng(seed)
    for e in range(epochs):
        order = r.permutation(n)
        rate = 0.03 * 0.85**e
        for at in range(0, n, size):
            part = [data[i] for i in order[at : at + size]]
            ids, mask = batch([t for t, _ in part])
            y = np.zeros(ids.shape, np.int64)
            for k, (t, spans) in enumerate(part):
                y[: len(t), k] = tags(len(t), spans)
            _, g = gradient(p, ids, mask, y)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k in p:
                gk = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.001 * (gk * gk - v[k])
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


@cache
def default_model() -> dict:
    """The model of the default parameters, trained once in a driver."""
    return train()


# --- windows over whole texts --------------------------------------------------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that hold every digit and "@" at least MARGIN characters from an edge (the text's ends apart), and of a name before
    "@", with or without a blank, up to NAME characters."""
    out: list[tuple[int, int]] = []
    last = -1
    for m in MARK.finditer(text):
        i = m.start()
        start = max(0, i - MARGIN)
        if text[i] == "@":
            at = i - 1 if i and text[i - 1] == " " else i
            while at > max(0, i - NAME) and text[at - 1] in LOCAL:
                at -= 1
            start = min(start, at)
        if i < last and start >= out[-1][0]:
            continue
        end = min(len(text), max(start + WINDOW, i + MARGIN))
        out.append((start, end))
        last = end - MARGIN if end < len(text) else len(text)
    return out


def decode(p: dict, texts: list[str], size: int = 256) -> list[list[Span]]:
    """Model spans of each text, windows reconciled."""
    jobs = [(k, a, b) for k, t in enumerate(texts) for a, b in windows(t)]
    jobs.sort(key=lambda j: j[2] - j[1])
    seen: list[list[tuple]] = [[] for _ in texts]  # of each text: windows with the tag and posterior of each character
    for at in range(0, len(jobs), size):
        part = jobs[at : at + size]
        ids, mask = batch([texts[k][a:b] for k, a, b in part])
        s, _ = _scores(p, ids, mask)
        best = viterbi(p, s, mask)
        f, bw = _forward(s, p["A"], mask), _backward(s, p["A"], mask)
        z = _lse(f[-1], 1)
        post = np.stack([np.exp(np.take_along_axis(f[t] + bw[t] - z[:, None], best[t][:, None], 1)[:, 0]) for t in range(len(s))])
        for j, (k, a, b) in enumerate(part):
            seen[k].append((a, b, best[: b - a, j].astype(np.int8), post[: b - a, j].astype(np.float32)))
    return [_reconciled(len(t), mine) for t, mine in zip(texts, seen, strict=True)]


def _reconciled(n: int, seen: list[tuple]) -> list[Span]:
    """Spans of a text of n characters: each character's tag is that of the window in which it lies farthest from an edge (the first of equals)."""
    if not any(tag.any() for _, _, tag, _ in seen):
        return []
    far, tags_, sure = np.full(n, -1, np.int16), np.zeros(n, np.int8), np.zeros(n, np.float32)
    for a, b, tag, post in sorted(seen, key=lambda x: x[:2]):
        i = np.arange(a, b)
        edge = np.minimum(np.minimum(i - a if a else WINDOW, b - 1 - i if b < n else WINDOW), np.full(b - a, WINDOW)).astype(np.int16)
        take = np.flatnonzero(edge > far[a:b])
        far[a + take], tags_[a + take], sure[a + take] = edge[take], tag[take], post[take]
    spans: list[Span] = []
    open_: list | None = None
    for i in np.flatnonzero(tags_).tolist():
        tag, kind = int(tags_[i]), (int(tags_[i]) - 1) // 2
        if open_ and tag % 2 == 0 and open_[0] == kind and open_[2] == i:
            open_[2], open_[3] = i + 1, min(open_[3], float(sure[i]))
            continue
        if open_ and open_[3] >= SURE:
            spans.append(tuple(open_[:3]))
        open_ = [kind, i, i + 1, float(sure[i])]
    if open_ and open_[3] >= SURE:
        spans.append(tuple(open_[:3]))
    return spans


def shaped(text: str, span: Span) -> bool:
    """Has a model span what its kind can't do without?"""
    kind, a, b = span
    s = text[a:b]
    n = sum(c in "0123456789" for c in s)
    before, after = text[a - 1 : a], text[b : b + 1]
    if before.isalnum() or after.isalnum():
        return False
    if kind == 0:
        return s.count("@") == 1 and "." in s.split("@")[1] and len(s.split("@")[0].strip()) > 0 and s[-1].isalpha()
    if kind == 1:
        return s.count(".") == 3 and all(_octet(x) for x in s.split("."))
    if kind == 2:
        return 13 <= n <= 19 and len(s) <= n + 5 and luhn("".join(c for c in s if c in "0123456789"))
    return 9 <= n <= 15 and (s[0] in "+(" or s.startswith("00")) and len(s) > n


def all_spans(p: dict, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, base and added spans) of each text."""
    base = [base_spans(t) for t in texts]
    full = []
    for t, mine, found in zip(texts, base, decode(p, texts), strict=True):
        new = [s for s in found if shaped(t, s) and all(s[2] <= a or b <= s[1] for _, a, b in mine)]
        full.append(sorted([*mine, *new]))
    return base, full


def find_pii(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    Null and empty texts: no spans, the hash of "". Repeated rows: a row each. An empty table: no rows. Positions are
    code points, ends exclusive. The model (about 50 KB) is trained on the driver and goes out with the tasks.
    """
    p = model or default_model()
    kind = docs.schema[id].dataType.simpleString()
    schema = f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            marked = [i for i, t in enumerate(texts) if MARK.search(t)]
            base, full = [[]] * len(texts), [[]] * len(texts)
            for at in range(0, len(marked), 512):
                part = marked[at : at + 512]
                for i, x, y in zip(part, *all_spans(p, [texts[i] for i in part]), strict=True):
                    base[i], full[i] = x, y
            counts = [[sum(s[0] == k for s in x) for x in base] for k in range(4)]
            sha = [sha256(written_spans(x).encode()).hexdigest() for x in base]
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(map(written_spans, full), pa.string()), pa.array([len(y) - len(x) for x, y in zip(base, full, strict=True)], pa.int64())], names)

    names = ["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    out = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id)
