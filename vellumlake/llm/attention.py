"""A small causal self-attention model in numpy over subword ids, and its training.

The model predicts the class of the next id from the ids in a window; within its class an id has its share of the corpus
counts. One attention layer: queries, keys, values and what goes straight on are linear in an id's embedding plus its
place's, so a trained model is a table of rows by id.

Weights of attention and of classes are powers of two, interpolated linearly between whole exponents: positive, monotone
and quickly had from a float's bits. They are divided by their sums, so probabilities add up to one; `bits` gives the
exact slope that gradients need.
"""

from __future__ import annotations

import numpy as np

#: Width of the model, ids in a window, how far windows are apart in scoring, and classes.
WIDTH, WINDOW, STRIDE, CLASSES = 16, 32, 24, 128
BATCH, RATE = 128, 0.01
#: Ids seen less often have no class of their own; common ids that neighbours are counted against; dimensions of what is clustered.
LEAST, COMMON, SPACE = 5, 512, 48
#: Stands in windows behind a text's end.
PAD = -1
#: Windows that are scored at once, and places whose classes are weighed at once.
CHUNK, ROWS = 128, 512
#: Exponents are kept within these.
FAR = np.float32(100)
KEEP = np.tril(np.ones((WINDOW, WINDOW), np.float32))

_MANTISSA, _ONE, _EXPONENT = np.float32(1 << 23), np.float32(127 << 23), np.int32(-(1 << 23))
_LEAST, _MOST = _ONE - FAR * _MANTISSA, _ONE + FAR * _MANTISSA


def powers(y: np.ndarray) -> np.ndarray:
    """Two to y (which is overwritten), linear between whole exponents."""
    np.clip(y, -FAR, FAR, out=y)
    y *= _MANTISSA
    y += _ONE
    return y.astype(np.int32).view(np.float32)


def slopes(w: np.ndarray) -> np.ndarray:
    """The derivative of powers, from what it gave."""
    return (w.view(np.int32) & _EXPONENT).view(np.float32)


def places(borders: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts seq[borders[i] : borders[i + 1]]: each one's text, and its number within the text."""
    n = np.diff(borders)
    windows = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // apart)), 0)
    text = np.repeat(np.arange(len(n)), windows)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)


def windows_of(seq: np.ndarray, borders: np.ndarray, begin: int, some=None) -> np.ndarray:
    """Windows of WINDOW + 1 ids, so that each id of the texts is predicted in one of them; the first of a text starts with
    begin, the last is filled up with PAD. some: of places(borders, WINDOW), those that are made."""
    text, number = places(borders, WINDOW) if some is None else some
    place = number[:, None] * WINDOW + np.arange(-1, WINDOW)
    out = seq[np.clip(borders[text][:, None] + place, 0, max(len(seq) - 1, 0))].astype(np.int32)
    out[place < 0] = begin
    out[place >= np.diff(borders)[text][:, None]] = PAD
    return out


def neighbours(windows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each id stands before and after common ids. place: a number from 0 for each common id, -1 for others. Keys
    are the id times twice the common ids plus the neighbour's place, those of ids before it after the others."""
    wide = 2 * (place.max() + 1)
    a, b = windows[:, :-1].ravel(), windows[:, 1:].ravel()
    a, b = a[b >= 0].astype(np.int64), b[b >= 0].astype(np.int64)
    keys = []
    for here, there, shift in ((a, b, 0), (b, a, wide // 2)):
        at = place[there]
        common = np.flatnonzero(at >= 0)
        keys.append(here[common] * wide + at[common] + shift)
    keys = np.concatenate(keys)
    if len(place) * wide < 1 << 31:
        keys = keys.astype(np.int32)  # half as much to sort
    seen = np.flatnonzero(np.bincount(np.concatenate([a, b]))) if len(a) else a
    if len(seen) * wide > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    # ids seen are few enough for a table of all that could be there
    rank = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
    rank[seen] = np.arange(len(seen))
    own = keys // wide
    n = np.bincount(keys + (rank[own] - own) * wide, minlength=len(seen) * wide)
    at = np.flatnonzero(n)
    return seen[at // wide] * wide + at % wide, n[at]


def spanned(z: np.ndarray) -> np.ndarray:
    return np.linalg.qr(z)[0].astype(np.float32)


def clustered(x: np.ndarray, seen: np.ndarray, count: np.ndarray, closing: np.ndarray, rng) -> np.ndarray:
    """A class for each id: k-means over x, the rows of the ids seen, weighted by the root of their counts; other ids have
    a class for those that close a word and one for the others."""
    out = np.where(closing, CLASSES - 2, CLASSES - 1)
    weight = np.sqrt(count[seen]).astype(np.float32)
    centre = x[rng.choice(len(seen), CLASSES - 2, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        own = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x * weight[:, None])
        mass = np.bincount(own, weights=weight, minlength=len(centre))
        centre = np.where(mass[:, None] > 0, total / np.maximum(mass, 1e-9)[:, None], centre).astype(np.float32)
    out[seen] = own
    return out


def few(seen: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Classes where fewer ids than classes are seen."""
    out = np.where(closing, CLASSES - 2, CLASSES - 1)
    out[seen] = np.arange(len(seen)) % (CLASSES - 2)
    return out


def drawn(cls: np.ndarray, count: np.ndarray, closing: np.ndarray, seed: int = 5) -> dict:
    """Parameters to begin with: e (embeddings by id; ids never seen have one of two), p (by place), m (queries, keys,
    values and what goes straight on, side by side), o and b (classes)."""
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    d = WIDTH
    e, never = draw(len(cls), d, scale=0.5), count == 0
    e[never] = draw(2, d, scale=0.5)[closing[never].astype(int)]
    m = np.concatenate([draw(d, d, scale=0.2), draw(d, d, scale=0.2), draw(d, d, scale=0.3), np.eye(d, dtype=np.float32)], 1)
    return {"e": e, "p": draw(WINDOW, d), "m": m, "o": draw(d, CLASSES, scale=0.4), "b": np.log2(np.bincount(cls, weights=count, minlength=CLASSES) + 1.0).astype(np.float32)}


def scaled(o: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """o and b in a matrix that takes rows of h and a one to what `powers` makes of floats' bits, and if nothing can get beyond FAR."""
    out = np.concatenate([o, b[None]]).astype(np.float32) * _MANTISSA
    out[-1] += _ONE
    return out, float((np.abs(o).sum(0) + np.abs(b)).max(initial=0)) < FAR


def raised(y: np.ndarray, bits: np.ndarray, near: bool) -> np.ndarray:
    """Powers of scaled exponents y (which is overwritten), in `bits` (32-bit integers of y's shape)."""
    if not near:
        np.clip(y, _LEAST, _MOST, out=y)
    np.copyto(bits, y, casting="unsafe")
    return bits.view(np.float32)


def with_one(x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    out[:, -1] = 1
    return out


def gradients(p: dict, e: np.ndarray, want: np.ndarray, real: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Of the mean loss over the real places: by parameter, by place's embedding e, and the loss in bits. The classes' part
    is done for ROWS places at a time, so that what it holds stays near the processor."""
    n, wide, d = *e.shape[:2], WIDTH
    x = (e + p["p"]).reshape(-1, d)
    y = (x @ p["m"]).reshape(n, wide, 4 * d)
    q, k, v = y[..., :d], y[..., d : 2 * d], y[..., 2 * d : 3 * d]
    a = powers(q @ k.transpose(0, 2, 1))
    a *= KEEP
    ds = slopes(a)
    under = (np.float32(1) / (a.reshape(-1, wide) @ np.ones(wide, np.float32))).reshape(n, wide, 1)
    a *= under
    ds *= under
    u = (a @ v).reshape(-1, d)
    u += y.reshape(-1, 4 * d)[:, 3 * d :]
    size = np.abs(u)
    size += 1
    h = np.empty((len(u), d + 1), np.float32)
    np.divide(u, size, out=h[:, :d])
    h[:, d] = 1
    real, want = real.ravel(), want.ravel()
    share = real / np.float32(real.sum())
    by, near = scaled(p["o"], p["b"])
    back = np.ascontiguousarray(p["o"].T)
    ones, du, go, gb, loss = np.ones(by.shape[1], np.float32), np.empty_like(u), np.zeros_like(back), np.zeros_like(by[0]), 0.0
    most = min(ROWS, len(h))
    z_, bits_, flat_ = np.empty((most, by.shape[1]), np.float32), np.empty((most, by.shape[1]), np.int32), np.arange(most) * by.shape[1]
    for at in range(0, len(h), most):
        some, s = h[at : at + most], share[at : at + most]
        z, bits = np.dot(some, by, out=z_[: len(some)]), bits_[: len(some)]
        w = raised(z, bits, near)
        total = w @ ones
        own = flat_[: len(some)] + want[at : at + most]
        got = w.ravel()[own]
        loss += float(s @ np.log2(total / got))
        bits &= _EXPONENT  # slopes
        dz = w.ravel()
        dz[own] -= dz[own] * total / got
        s = s / total
        gb += s @ w
        s = s[:, None]
        go += w.T @ (some[:, :d] * s)  # quicker than its transpose
        np.multiply(w @ back, s, out=du[at : at + most])
    g = {"o": np.ascontiguousarray(go.T), "b": gb}
    size *= size
    du /= size
    du3 = du.reshape(n, wide, d)
    da = du3 @ v.transpose(0, 2, 1)
    da -= ((da.reshape(-1, wide) * a.reshape(-1, wide)) @ np.ones(wide, np.float32)).reshape(n, wide, 1)
    ds *= da
    dy = np.empty((n, wide, 4 * d), np.float32)
    np.matmul(ds, k, out=dy[..., :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dy[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), du3, out=dy[..., 2 * d : 3 * d])
    dy[..., 3 * d :] = du3
    dy = dy.reshape(-1, 4 * d)
    g["m"] = x.T @ dy
    dx = dy @ p["m"].T
    g["p"] = dx.reshape(n, wide * d).sum(0).reshape(wide, d)
    return g, dx, loss


class Learner:
    """Goes on from parameters with a row of p["e"] for each id, by Adam, of which an id's row takes part in the steps that
    hold it. weight: how many windows were learnt; seen: in how many steps each id was."""

    def __init__(self, p: dict, cls: np.ndarray, rate: float):
        self.p, self.cls, self.rate = {k: v.copy() for k, v in p.items()}, cls, rate
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.seen, self.weight, self.steps = np.zeros(len(cls), np.int64), 0, 0

    def learn(self, w: np.ndarray) -> float:
        """One step on windows; what is behind a text's end isn't learnt."""
        p = self.p
        inside = w[:, :-1] >= 0
        real, ids = w[:, 1:] >= 0, np.where(inside, w[:, :-1], 0)
        g, dx, loss = gradients(p, np.take(p["e"], ids, axis=0), np.take(self.cls, w[:, 1:], mode="wrap"), real)
        key, flat = ids.ravel().astype(np.uint16 if len(self.cls) <= 1 << 16 else np.int64), None
        if not inside.all():
            flat = np.flatnonzero(inside.ravel())
            key = key[flat]
        order = np.argsort(key, kind="stable")  # of 16 bits, by radix
        key = key[order]
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        own, y = key[starts].astype(np.int64), np.add.reduceat(np.take(dx, order if flat is None else flat[order], axis=0), starts)
        self.steps, self.weight = self.steps + 1, self.weight + len(w)
        self.seen[own] += 1
        first, second, rows = (np.take(x, own, axis=0) for x in (self.first["e"], self.second["e"], p["e"]))
        seen = self.seen[own][:, None].astype(np.float32)
        self._step(first, second, rows, y, 1 - np.float32(0.9) ** seen, 1 - np.float32(0.99) ** seen)
        self.first["e"][own], self.second["e"][own], p["e"][own] = first, second, rows
        for name, y in g.items():
            self._step(self.first[name], self.second[name], p[name], y, np.float32(1 - 0.9**self.steps), np.float32(1 - 0.99**self.steps))
        return loss

    def _step(self, first: np.ndarray, second: np.ndarray, x: np.ndarray, y: np.ndarray, under, under_square) -> None:
        """Adam's step of x along y, in place, in single precision."""
        first *= np.float32(0.9)
        first += np.float32(0.1) * y
        second *= np.float32(0.99)
        y = y * y
        y *= np.float32(0.01)
        second += y
        np.divide(second, under_square, out=y)
        np.sqrt(y, out=y)
        y += np.float32(1e-8)
        y *= under
        np.divide(first, y, out=y)
        y *= np.float32(self.rate)
        x -= y


def fitted(windows: np.ndarray, p: dict, cls: np.ndarray, steps: int, batch: int = 64, seed: int = 5) -> dict:
    """p after steps on windows drawn again and again, the rate falling in the second half."""
    rng = np.random.default_rng(seed)
    m = Learner(p, cls, RATE)
    for step in range(steps):
        m.rate = RATE * min(1, 2 * (1 - step / steps))
        m.learn(windows[rng.integers(0, len(windows), batch)])
    return m.p


class Attention:
    """The trained model: rows of query, key, value and what goes straight on by id, and the like by place."""

    def __init__(self, cls: np.ndarray, p: dict):
        self.table, self.place = p["e"] @ p["m"], p["p"] @ p["m"]
        self.cls, self.o, self.b = cls, p["o"], p["b"]

    def score(self, ids: np.ndarray, borders: np.ndarray, begin: int) -> np.ndarray:
        """For each id of the texts ids[borders[i] : borders[i + 1]] the log10 probability of its class. Windows overlap; an
        id is scored once, in the first window that holds it, so all but a text's first WINDOW ids have WINDOW - STRIDE ids
        or more before them in the window."""
        n = np.diff(borders)
        text, number = places(borders, STRIDE)
        out = np.zeros(len(ids), np.float32)
        before = np.empty(len(ids) + 1, np.int64)  # of each place, the id before it
        before[1:] = ids
        before[borders[:-1][n > 0]] = begin
        target, d = self.cls[ids], WIDTH
        by, near = scaled(self.o, self.b)
        ones, all_, place = np.ones((WINDOW, 1), np.float32), np.ones(by.shape[1], np.float32), np.arange(WINDOW)
        z_, bits_, flat_ = np.empty((ROWS, by.shape[1]), np.float32), np.empty((ROWS, by.shape[1]), np.int32), np.arange(ROWS) * by.shape[1]
        first = number == 0
        for skip, group in ((0, np.flatnonzero(first)), (WINDOW - STRIDE, np.flatnonzero(~first))):  # places that the window before scores
            keep, later = KEEP[skip:], place[skip:]
            for at in range(0, len(group), CHUNK):
                t, w = text[group[at : at + CHUNK]], number[group[at : at + CHUNK]]
                start = (borders[t] + w * STRIDE)[:, None]
                left = (borders[t + 1])[:, None] - start
                where = start + place
                x = np.take(self.table, before[np.minimum(where, len(ids) - 1)], axis=0)
                x += self.place
                a = powers(x[:, skip:, :d] @ x[..., d : 2 * d].transpose(0, 2, 1))
                a *= keep
                h = a @ x[..., 2 * d : 3 * d]
                h /= a @ ones  # sums along short rows are quicker as products
                h += x[:, skip:, 3 * d :]
                inside = np.flatnonzero(later < left)
                u = np.take(h.reshape(-1, d), inside, axis=0)
                h = np.empty((len(u), d + 1), np.float32)
                np.divide(u, np.abs(u) + 1, out=h[:, :d])
                h[:, d] = 1
                at_ = where[:, skip:].ravel()[inside]
                for k in range(0, len(h), ROWS):
                    some = h[k : k + ROWS]
                    z = raised(np.dot(some, by, out=z_[: len(some)]), bits_[: len(some)], near)
                    here = at_[k : k + ROWS]
                    out[here] = np.log10(z.ravel()[flat_[: len(some)] + target[here]] / (z @ all_))
        return out
