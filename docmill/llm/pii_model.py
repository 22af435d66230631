"""A character-level bidirectional LSTM with CRF transitions in numpy: training and decoding.

Gates are piecewise linear, so that a step is a few passes over small arrays.  One tag stands for
each type and one for the rest; transitions hold runs together.
"""

from __future__ import annotations

import multiprocessing
import time
import unicodedata

import numpy as np

_clip = getattr(np, "_core", np).umath.clip if hasattr(np, "_core") else np.clip

TYPES = ["email", "phone", "identity_number", "street_address", "person_name"]
TAGS = len(TYPES) + 1
HIDDEN = 32
PAD = 0


def _classes() -> np.ndarray:
    """Class of each code point below 0x2100; accented letters count as their base, others by kind."""
    out = np.full(0x2100, 4, dtype=np.uint8)
    for code in range(0x2100):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1]
        if 32 <= code < 127:
            out[code] = code - 32 + 8
        elif c in "\n\r":
            out[code] = 1
        elif c.isspace():
            out[code] = 8
        elif base and 32 <= ord(base) < 127:
            out[code] = ord(base) - 32 + 8
        elif c in "‐‑‒–—―":
            out[code] = ord("-") - 32 + 8
        elif c in "‘’":
            out[code] = ord("'") - 32 + 8
        elif c.isupper():
            out[code] = 2
        elif c.isalpha():
            out[code] = 3
        elif c.isdigit():
            out[code] = 5
    return out


CLASSES = _classes()
N_CLASSES = 8 + 95


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    if text.isascii():
        return CLASSES[np.frombuffer(text.encode(), dtype=np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CLASSES[np.minimum(points, 0x20FF)]


def fresh(hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
        p[f"x{d}"][:, hidden : 2 * hidden] += 2.0
        p[f"h{d}"] = rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 4 * hidden))
    p["o"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
    p["ob"] = np.zeros(TAGS)
    p["t"] = np.eye(TAGS) * 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def widen(p: dict[str, np.ndarray], hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Weights with more cells: the old ones as they are, the new ones fresh and weak on the old."""
    n, out = p["hf"].shape[0], fresh(hidden)
    if n == hidden:
        return dict(p)
    for d in "fb":
        for g in range(4):
            old, new = slice(g * n, g * n + n), slice(g * hidden, g * hidden + n)
            out[f"x{d}"][:, new] = p[f"x{d}"][:, old]
            out[f"h{d}"][n:, new] *= 0.1
            out[f"h{d}"][:n, new] = p[f"h{d}"][:, old]
    out["o"] *= 0.1
    out["o"][:n], out["o"][hidden : hidden + n] = p["o"][:n], p["o"][n:]
    out["ob"], out["t"] = p["ob"].copy(), p["t"].copy()
    return out


def _run(x: np.ndarray, table: np.ndarray, rec: np.ndarray, keep: bool):
    """x[T, B] classes -> h[T, B, H]; with keep also what the gradient needs. Gates: input, forget, output, cell."""
    steps, batch = x.shape
    n = rec.shape[0]
    hs = np.empty((steps, batch, n), dtype=np.float32)
    saved = []
    h = np.zeros((batch, n), dtype=np.float32)
    c = np.zeros((batch, n), dtype=np.float32)
    z, own, squashed = (np.empty((batch, k * n), dtype=np.float32) for k in (4, 4, 1))
    for s in range(steps):
        np.matmul(h, rec, out=z)
        z += np.take(table, x[s], axis=0, out=own, mode="clip")
        gates, cell = z[:, : 3 * n], z[:, 3 * n :]
        if keep:
            inside = (np.abs(gates) < 2.0, np.abs(cell) < 1.0)
        gates *= 0.25
        gates += 0.5
        np.maximum(gates, 0.0, out=gates)
        np.minimum(gates, 1.0, out=gates)
        np.maximum(cell, -1.0, out=cell)
        np.minimum(cell, 1.0, out=cell)
        before = c
        c = np.multiply(z[:, n : 2 * n], c, out=None if keep else c)
        cell_in = z[:, :n] * cell
        c += cell_in
        squashed = np.maximum(c, -1.0, out=None if keep else squashed)
        np.minimum(squashed, 1.0, out=squashed)
        h = np.multiply(z[:, 2 * n : 3 * n], squashed, out=hs[s])
        if keep:
            saved.append((z.copy(), before, c, squashed, inside))
    return hs, saved


def ready(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights for reading: digits alike, the gates' slope and offset taken into the weights, gate by gate."""
    out = dict(p)
    n = p["hf"].shape[0]
    digits = slice(ord("0") - 24, ord("9") - 23)
    for d in "fb":
        table, rec = p[f"x{d}"].copy(), p[f"h{d}"].copy()
        table[digits] = table[digits].mean(axis=0)
        table[:, : 3 * n] = table[:, : 3 * n] * 0.25 + 0.5
        rec[:, : 3 * n] *= 0.25
        for key, w in ((f"x{d}", table), (f"h{d}", rec)):
            out[key] = np.ascontiguousarray(w.reshape(len(w), 4, n).transpose(1, 0, 2))
    return out


def _read(x: np.ndarray, table: np.ndarray, rec: np.ndarray, part: np.ndarray, e: np.ndarray, back: bool) -> None:
    """The pass of _run with weights from ready, from the last step to the first with back; what it says by part is added to e.

    Each gate is an array of its own, so that every operation runs over whole arrays.
    """
    steps, batch = x.shape
    n = rec.shape[1]
    z, own = (np.zeros((4, batch, n), dtype=np.float32) for _ in range(2))
    h, c = (np.zeros((batch, n), dtype=np.float32) for _ in range(2))
    said = np.empty((part.shape[1], batch), dtype=np.float32)
    gates, (i, f, o, cell) = z[:3], z
    for s in range(steps - 1, -1, -1) if back else range(steps):
        np.matmul(h, rec, out=z)
        z += table.take(x[s], axis=1, out=own, mode="clip")
        _clip(gates, 0.0, 1.0, out=gates)
        _clip(cell, -1.0, 1.0, out=cell)
        c *= f
        cell *= i
        c += cell
        _clip(c, -1.0, 1.0, out=h)
        h *= o
        e[s] += np.matmul(part.T, h.T, out=said)


def emissions(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """x[T, B] -> scores[T, B, TAGS], with weights from ready; in memory tags come before columns."""
    n = len(p["o"]) // 2
    e = np.empty((len(x), TAGS, x.shape[1]), dtype=np.float32)
    e[:] = p["ob"][:, None]
    _read(x, p["xf"], p["hf"], p["o"][:n], e, False)
    _read(x, p["xb"], p["hb"], p["o"][n:], e, True)
    return e.transpose(0, 2, 1)


#: Places x stretches decoded together.
PLACES = 1 << 15


def stretches(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, begin, end) of the places that a run of tags may hold; elsewhere the rest is best, whatever stands beside it.

    A run gains at most the sum of what the best tag has over the rest at its places, and
    what staying in tags may add, less what entering and leaving cost; a run from the first
    place need not enter, and one to the last need not leave.
    """
    steps, batch, k = e.shape
    gain = np.maximum(e[:, :, 1], e[:, :, 2])
    for j in range(3, k):
        np.maximum(gain, e[:, :, j], out=gain)
    gain -= e[:, :, 0]
    stay, enter, leave = max(0.0, float(t[1:, 1:].max() - t[0, 0])), float(t[0, 0] - t[0, 1:].max()), float(t[0, 0] - t[1:, 0].max())
    gain += stay
    gain[0] += enter
    gain[-1] += leave
    most = gain.copy()  # of the runs that end at a place, then of all that hold it
    for s in range(1, steps):
        most[s] += np.maximum(most[s - 1], 0.0)
    live = np.flatnonzero(most.max(axis=0) > stay + enter + leave - 1e-3)
    gain, most = gain[:, live], most[:, live]
    after = np.zeros(len(live), dtype=np.float32)
    for s in range(steps - 2, -1, -1):
        after += gain[s + 1]
        np.maximum(after, 0.0, out=after)
        most[s] += after
    edges = np.zeros((len(live), steps + 2), dtype=np.int8)
    edges[:, 1:-1] = (most > stay + enter + leave - 1e-3).T
    edges = np.diff(edges, axis=1)
    column, begin = np.nonzero(edges == 1)
    return live[column], begin, np.nonzero(edges == -1)[1]


def decoded(values: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best tags of stretches, one after the other: of their scores values[places, TAGS] and lengths, where some are the first or the last of their text.

    Stretches of similar length are decoded together.
    """
    k = values.shape[1]
    tags = np.zeros(len(values), dtype=np.uint8)
    starts = np.cumsum(length) - length
    order = np.argsort(length, kind="stable")
    across = np.ascontiguousarray(t)[:, :, None]
    while len(order):
        part = order[: max(1, PLACES // int(length[order[0]]))]
        part = part[: max(1, PLACES // int(length[part[-1]]))]
        order = order[len(part) :]
        n = length[part]
        place = np.arange(n[-1] + 1)[:, None]  # the rest stands before a stretch and after it
        at = np.minimum(place, n - 1) + starts[part]
        inside = place < n
        x = np.ascontiguousarray(values[at].transpose(0, 2, 1))  # tags before columns: each maximum runs over whole rows
        x[:, 0][~inside] = 0.0
        for j in range(1, k):
            x[:, j][~inside] = -1e6
        x[0] += np.where(first[part], np.float32(0.0), t[0][:, None])
        ends = np.flatnonzero(last[part])
        x[n[ends] - 1, :, ends] -= t[:, 0]  # nothing comes after
        score = np.empty_like(x)
        score[0] = x[0]
        for s in range(1, len(x)):
            np.maximum.reduce(score[s - 1][:, None, :] + across, axis=0, out=score[s])
            score[s] += x[s]
        best = np.zeros(len(part), dtype=np.int64)
        path = np.zeros(at.shape, dtype=np.uint8)
        for s in range(len(x) - 2, -1, -1):
            best = (score[s] + t[:, best]).argmax(axis=0)
            path[s] = best
        tags[at[inside]] = path[inside]
    return tags


def places(column: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, column) of each place of stretches, one after the other."""
    length = end - begin
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - begin, length), np.repeat(column, length)


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best tags[T, B]; only stretches are decoded."""
    tags = np.zeros(e.shape[:2], dtype=np.uint8)
    column, begin, end = stretches(e, t)
    at = places(column, begin, end)
    tags[at] = decoded(e[at], end - begin, begin == 0, end == len(e), t)
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood of tags y[T, B] for characters x[T, B], per character."""
    steps, batch = x.shape
    n = p["hf"].shape[0]
    f, fs = _run(x, p["xf"], p["hf"], True)
    b, bs = _run(x[::-1], p["xb"], p["hb"], True)
    b = b[::-1]
    e = f @ p["o"][:n] + b @ p["o"][n:] + p["ob"]
    t = p["t"]
    alpha = np.empty_like(e)
    beta = np.zeros_like(e)
    alpha[0] = e[0]
    for s in range(1, steps):
        alpha[s] = _lse(alpha[s - 1][:, :, None] + t[None], 1) + e[s]
    for s in range(steps - 2, -1, -1):
        beta[s] = _lse((beta[s + 1] + e[s + 1])[:, None, :] + t[None], 2)
    z = _lse(alpha[-1], 1)
    post = np.exp(alpha + beta - z[None, :, None])
    gold = np.take_along_axis(e, y[:, :, None].astype(np.int64), 2).sum() + t[y[:-1], y[1:]].sum()
    total = steps * batch
    loss = float((z.sum() - gold) / total)
    ge = post
    np.put_along_axis(ge, y[:, :, None].astype(np.int64), np.take_along_axis(ge, y[:, :, None].astype(np.int64), 2) - 1, 2)
    ge = (ge / total).astype(np.float32)
    gt = np.zeros_like(t)
    for s in range(1, steps):
        gt += np.exp(alpha[s - 1][:, :, None] + t[None] + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(axis=0)
    np.add.at(gt, (y[:-1].ravel(), y[1:].ravel()), -1.0)
    g = {"t": (gt / total).astype(np.float32), "ob": ge.sum(axis=(0, 1)), "o": np.concatenate([np.einsum("tbh,tbk->hk", f, ge), np.einsum("tbh,tbk->hk", b, ge)])}
    for d, hs, saved, part, xs in (("f", f, fs, p["o"][:n], x), ("b", b[::-1], bs, p["o"][n:], x[::-1])):
        gh_out = ge @ part.T if d == "f" else ge[::-1] @ part.T
        gx = np.zeros_like(p[f"x{d}"])
        grec = np.zeros_like(p[f"h{d}"])
        gh = np.zeros((batch, n), dtype=np.float32)
        gc = np.zeros((batch, n), dtype=np.float32)
        rec_t = p[f"h{d}"].T
        all_gz = np.empty((steps, batch, 4 * n), dtype=np.float32)
        for s in range(steps - 1, -1, -1):
            zz, before, c, squashed, (in_gates, in_cell) = saved[s]
            gh += gh_out[s]
            gz = all_gz[s]
            gz[:, 2 * n : 3 * n] = gh * squashed
            gc += gh * zz[:, 2 * n : 3 * n] * (np.abs(c) < 1.0)
            gz[:, :n] = gc * zz[:, 3 * n :]
            gz[:, n : 2 * n] = gc * before
            gz[:, 3 * n :] = gc * zz[:, :n] * in_cell
            gz[:, : 3 * n] *= 0.25 * in_gates
            gc *= zz[:, n : 2 * n]
            gh = gz @ rec_t
        grec += np.tensordot(hs[:-1], all_gz[1:], axes=([0, 1], [0, 1]))
        flat = xs.ravel()
        by = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(np.diff(flat[by].astype(np.int64), prepend=-1))
        gx[flat[by][begins]] = np.add.reduceat(all_gz.reshape(-1, 4 * n)[by], begins, axis=0)
        g[f"x{d}"], g[f"h{d}"] = gx, grec
    return loss, g


def _work(connection, x_all: list, y_all: list, groups: list, seed: int, batch: int) -> None:
    rng = np.random.default_rng(seed)
    while (p := connection.recv()) is not None:
        bucket = groups[rng.choice(len(groups), p=np.array([len(g) for g in groups]) / sum(map(len, groups)))]
        pick = rng.choice(bucket, size=batch)
        width = max(len(x_all[i]) for i in pick)
        x = np.full((width, batch), PAD, dtype=np.uint8)
        y = np.zeros((width, batch), dtype=np.uint8)
        for j, i in enumerate(pick):
            x[: len(x_all[i]), j] = x_all[i]
            y[: len(y_all[i]), j] = y_all[i]
        connection.send(loss_and_gradient(x, y, p))


def train(texts: list[np.ndarray], tags: list[np.ndarray], seconds: float, workers: int = 8, batch: int = 64, rate: float = 6e-3, start: dict | None = None) -> dict[str, np.ndarray]:
    """Adam over batches of similar length, their gradients averaged over the workers."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    size = max(batch * 4, len(order) // 24)
    groups = [np.array(order[i : i + size]) for i in range(0, len(order), size)]
    pipes, processes = [], []
    fork = multiprocessing.get_context("fork")
    for w in range(workers):
        here, there = fork.Pipe()
        processes.append(fork.Process(target=_work, args=(there, texts, tags, groups, 100 + w, batch), daemon=True))
        processes[-1].start()
        pipes.append(here)
    p = start or fresh()
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    began, step, shown, mean = time.time(), 0, 0.0, 1.0
    while (gone := time.time() - began) < seconds:
        step += 1
        for c in pipes:
            c.send(p)
        got = [c.recv() for c in pipes]
        loss = float(np.mean([a for a, _ in got]))
        mean += 0.02 * (loss - mean)
        lr = rate * min(1.0, step / 50) * (1 - gone / seconds + 0.02)
        norm = 0.0
        grads = {k: np.mean([g[k] for _, g in got], axis=0) for k in p}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if gone - shown > 20:
            shown = gone
            print(f"{gone:.0f} s, step {step}, loss {mean:.5f}", flush=True)
    for c in pipes:
        c.send(None)
    for q in processes:
        q.join(5)
    return p
