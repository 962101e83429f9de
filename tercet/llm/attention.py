"""A small causal self-attention model over subword ids, trained and applied in numpy.

One attention head with learned relative biases, a feed-forward layer, and a two-level softmax
(class, then member), on top of the corpus' own bigram statistics: the token before gives the
logits' offsets, and attention learns what the context adds. Windows overlap: each has HEAD tokens
of context before the STEP tokens that it scores, so every token is scored once.
"""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN = 32, 32
HEAD, STEP = 8, 24
SPAN = HEAD + STEP
SIDE = 32  #: classes, and members of a class
VOCAB = SIDE * SIDE
SUBWORDS = 1000  #: first ids of the public byte-level vocabulary that are used
BEGIN, END, PAD = SUBWORDS, SUBWORDS + 1, SUBWORDS + 2
#: Powers of e up to this one can be summed in single precision.
EXP_RANGE = 60.0
LN10 = float(np.log(10.0))


def windows(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, SPAN), targets (n, STEP; PAD where none) and the document of each window.

    ``ids`` are the documents' ids on end, each closed by END; ``place`` says where each begins.
    """
    sizes = np.diff(place)
    per_doc = -(-sizes // STEP)
    room = np.where(per_doc > 0, HEAD + STEP * per_doc, 0)
    base = np.cumsum(room) - room
    inputs = np.full(int(room.sum()), PAD, np.int32)
    targets = inputs.copy()
    at = np.arange(len(ids)) - np.repeat(place[:-1], sizes) + np.repeat(base + HEAD, sizes)
    targets[at] = ids
    inputs[at[:-1] + 1 if len(at) else at] = ids[:-1] if len(ids) else ids
    held = sizes > 0
    inputs[base[held] + HEAD] = BEGIN
    # what follows a document's END belongs to no window's inputs but as padding
    ends = base[held] + HEAD + sizes[held]
    ends = ends[ends < len(inputs)]
    inputs[ends] = PAD
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    starts = base[doc] + STEP * number
    return inputs[starts[:, None] + np.arange(SPAN)], targets[(starts + HEAD)[:, None] + np.arange(STEP)], doc


def offsets(bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log offsets by the token before: of classes (VOCAB, SIDE) and members (SIDE, VOCAB, SIDE)."""
    single = bigrams.sum(axis=0) + 0.1
    single[[BEGIN, PAD]] = 1e-6
    single[END + 2 :] = 1e-6
    single /= single.sum()
    smooth = (bigrams + 20.0 * single) / (bigrams.sum(axis=1, keepdims=True) + 20.0)
    grouped = smooth.reshape(VOCAB, SIDE, SIDE)
    classes = grouped.sum(axis=2)
    members = grouped / classes[:, :, None]
    return np.log(classes).astype(np.float32), np.ascontiguousarray(np.log(members).transpose(1, 0, 2)).astype(np.float32)


def _bias(relative: np.ndarray) -> np.ndarray:
    i, j = np.arange(STEP)[:, None] + HEAD, np.arange(SPAN)[None, :]
    return np.where(j <= i, relative[np.clip(i - j, 0, SPAN - 1)], -1e4).astype(np.float32)


def _log_of_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of e^x of each row; ``x`` is used up."""
    shift = x.max(axis=1) if x.size and max(x.max(), -x.min()) > EXP_RANGE else None
    if shift is not None:
        x -= shift[:, None]
    np.exp(x, out=x)
    out = np.log(x @ np.ones(x.shape[1], x.dtype))  # a product sums rows of few columns faster than a reduction
    return out if shift is None else out + shift


class Model:
    def __init__(self, bigrams: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = {"E": (VOCAB, WIDTH), "Wq": (WIDTH, WIDTH), "Wk": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH), "Wo": (WIDTH, WIDTH), "W1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, WIDTH), "R": (SPAN,), "Uc": (WIDTH, SIDE), "Um": (SIDE, WIDTH, SIDE)}
        scale = {"E": 0.3, "b1": 0, "R": 0, "Uc": 0.02, "Um": 0.02}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in shape.items()}
        self.classes, self.members = offsets(bigrams)
        self._ready, self._held = None, self._no_room()

    def loss_and_gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Query and key weights act as one product, value and output weights as another; their gradients follow from the products'."""
        p, root, n = self.p, np.float32(WIDTH**0.5), targets.size
        ones = np.ones(SIDE, np.float32)  # a product sums rows of few columns faster than a reduction
        meets, moves = p["Wq"] @ p["Wk"].T / root, p["Wv"] @ p["Wo"]
        x = p["E"].take(inputs, axis=0)
        flat_x, xq = x.reshape(-1, WIDTH), np.ascontiguousarray(x[:, HEAD:]).reshape(n, WIDTH)
        qa = (xq @ meets).reshape(-1, STEP, WIDTH)
        vo = (flat_x @ moves).reshape(x.shape)
        s = qa @ x.transpose(0, 2, 1)
        held = (inputs != PAD)[:, None, :]
        if max(s.max(), -s.min()) + np.abs(p["R"]).max() > EXP_RANGE:
            s += _bias(p["R"])
            s += np.where(held, np.float32(0), np.float32(-1e4))
            s -= s.max(axis=2, keepdims=True)
            a = np.exp(s, out=s)
        else:
            a = np.exp(s, out=s)
            a *= np.exp(_bias(p["R"]))
            a *= held
        a /= (a @ ones)[:, :, None]
        h = (a @ vo).reshape(n, WIDTH)
        h += xq
        z = h @ p["W1"]
        z += p["b1"]
        r = np.maximum(z, 0)
        flat = r @ p["W2"]
        flat += h
        goal = targets.reshape(n)
        order = np.argsort((goal // SIDE).astype(np.uint8), kind="stable")
        order = order[goal[order] != PAD]
        goal, prev, own = goal[order], inputs[:, HEAD:].reshape(n)[order], flat.take(order, axis=0)
        c, m, rows, total = goal // SIDE, goal % SIDE, np.arange(len(goal)), np.float32(len(goal))
        edges = np.searchsorted(c, np.arange(SIDE + 1))
        groups = [(one, slice(low, high)) for one, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if low < high]
        pc = own @ p["Uc"]
        pc += self.classes.take(prev, axis=0)
        pm = self.members.reshape(-1, SIDE).take(c * VOCAB + prev, axis=0).astype(own.dtype, copy=False)
        for one, part in groups:
            pm[part] += own[part] @ p["Um"][one]
        loss = 0.0
        for each, at in ((pc, c), (pm, m)):
            each -= each.max(axis=1, keepdims=True)
            np.exp(each, out=each)
            each /= (each @ ones)[:, None]
            loss -= float(np.log(each[rows, at] + np.float32(1e-30)).sum(dtype=np.float64)) / max(len(goal), 1)
            each[rows, at] -= 1
            each /= max(total, np.float32(1))
        g = {"Uc": own.T @ pc, "Um": np.zeros_like(p["Um"])}
        back = pc @ p["Uc"].T
        for one, part in groups:
            np.matmul(own[part].T, pm[part], out=g["Um"][one])
            back[part] += pm[part] @ p["Um"][one].T
        dh2 = np.zeros((n, WIDTH), own.dtype)
        dh2[order] = back
        g["W2"] = r.T @ dh2
        dz = dh2 @ p["W2"].T
        dz *= z > 0
        g["W1"], g["b1"] = h.T @ dz, dz.sum(axis=0)
        dh2 += dz @ p["W1"].T
        dh = dh2.reshape(-1, STEP, WIDTH)
        ds = dh @ vo.transpose(0, 2, 1)
        dvo = (a.transpose(0, 2, 1) @ dh).reshape(-1, WIDTH)
        ds -= ((ds * a) @ ones)[:, :, None]
        ds *= a
        i, j = np.arange(STEP)[:, None] + HEAD, np.arange(SPAN)[None, :]
        g["R"] = np.bincount((i - j)[j <= i], weights=ds.sum(axis=0)[j <= i], minlength=SPAN).astype(np.float32)
        dqa = (ds @ x).reshape(n, WIDTH)
        dx = ds.transpose(0, 2, 1) @ qa
        dmeets, dmoves = xq.T @ dqa / root, flat_x.T @ dvo
        g["Wq"], g["Wk"] = dmeets @ p["Wk"], dmeets.T @ p["Wq"]
        g["Wv"], g["Wo"] = dmoves @ p["Wo"].T, p["Wv"].T @ dmoves
        dx += (dvo @ moves.T).reshape(x.shape)
        dh2 += dqa @ meets.T
        dx[:, HEAD:] += dh
        cell = inputs.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        g["E"] = np.bincount(cell.ravel(), weights=dx.ravel(), minlength=VOCAB * WIDTH).reshape(VOCAB, WIDTH).astype(p["E"].dtype)
        return loss, g

    def train(self, inputs: np.ndarray, targets: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.01, seed: int = 4) -> list[float]:
        """Adam over random batches of windows; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        first, second = self.moments = tuple({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1 if len(inputs) else 1):
            pick = rng.integers(0, len(inputs), batch)
            loss, grads = self.loss_and_gradients(inputs[pick], targets[pick])
            losses.append(loss)
            step = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self._ready = None
        return losses

    def follow(self, inputs: np.ndarray, targets: np.ndarray, rate: float = 0.001) -> None:
        """One further step of Adam, with the moments that :meth:`train` left."""
        first, second = self.moments
        for k, g in self.loss_and_gradients(inputs, targets)[1].items():
            first[k] *= np.float32(0.9)
            first[k] += np.float32(0.1) * g
            second[k] *= np.float32(0.99)
            second[k] += np.float32(0.01) * g * g
            self.p[k] = self.p[k] - np.float32(rate) * first[k] / (np.sqrt(second[k]) + np.float32(1e-8))
        self._ready = None

    def ready(self) -> tuple:
        """What scoring looks up by token ids, computed once: the attention of any two ids (e to the power of query times
        key, or that power itself where its range is too wide), its relative biases alike, values with a column of ones."""
        if self._ready is None:
            p = self.p
            affinity = (p["E"] @ p["Wq"] / np.float32(WIDTH**0.5)) @ (p["E"] @ p["Wk"]).T
            bias = _bias(p["R"])
            wide = bool(np.abs(affinity).max() + np.abs(p["R"]).max() > EXP_RANGE)
            affinity[:, PAD] = -1e4
            if not wide:
                np.exp(affinity, out=affinity)
                bias = np.exp(bias)
            values = np.concatenate((p["E"] @ p["Wv"] @ p["Wo"], np.ones((VOCAB, 1), np.float32)), axis=1)
            self._ready = (np.ascontiguousarray(affinity).ravel(), np.ascontiguousarray(values), bias, wide)
        return self._ready

    def _room(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (n, STEP, SPAN) for table cells and for attention, kept from one chunk to the next."""
        if len(self._held[0]) < n:
            self._held = np.empty((n, STEP, SPAN), np.intp), np.empty((n, STEP, SPAN), np.float32)
        return self._held[0][:n], self._held[1][:n]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_held": self._no_room()}

    @staticmethod
    def _no_room() -> tuple[np.ndarray, np.ndarray]:
        return np.empty((0, STEP, SPAN), np.intp), np.empty((0, STEP, SPAN), np.float32)

    def score_windows(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of the targets of each window."""
        return self.log_chances(inputs, targets).sum(axis=1, dtype=np.float64) / LN10

    def log_chances(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of every target; 0 for padding."""
        affinity, values, bias, wide = self.ready()
        p, n = self.p, targets.size
        prev = inputs[:, HEAD:]
        cells, s = self._room(len(inputs))
        np.add((prev.astype(np.intp) * VOCAB)[:, :, None], inputs[:, None, :], out=cells)
        affinity.take(cells, out=s, mode="clip")  # ids are in range; without the check nothing is copied twice
        if wide:
            s += bias
            s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
        else:
            s *= bias
        mixed = np.matmul(s, values.take(inputs, axis=0, mode="clip")).reshape(n, WIDTH + 1)
        h = mixed[:, :WIDTH] / mixed[:, WIDTH:]
        prev, goal = prev.reshape(n), targets.reshape(n)
        h += p["E"].take(prev, axis=0, mode="clip")
        z = h @ p["W1"]
        z += p["b1"]
        np.maximum(z, 0, out=z)
        h += z @ p["W2"]
        c, m = (goal // SIDE).astype(np.uint8), goal % SIDE
        lc = h @ p["Uc"]
        lc += self.classes.take(prev, axis=0, mode="clip")
        out = lc[np.arange(n), c]
        out -= _log_of_sum(lc)
        order = np.argsort(c, kind="stable")
        h, prev, m = h.take(order, axis=0), prev[order], m[order]
        edges = np.searchsorted(c[order], np.arange(SIDE + 1))
        lm = np.empty((n, SIDE), np.float32)
        for k in range(SIDE):
            low, high = edges[k], edges[k + 1]
            if low < high:
                np.matmul(h[low:high], p["Um"][k], out=lm[low:high])
                lm[low:high] += self.members[k].take(prev[low:high], axis=0, mode="clip")
        got = lm[np.arange(n), m]
        out[order] += got - _log_of_sum(lm)
        out[goal == PAD] = 0
        return out.reshape(targets.shape)

    def score(self, ids: np.ndarray, place: np.ndarray, chunk: int = 384) -> np.ndarray:
        """log10 probability of each document's ids (closed by END)."""
        inputs, targets, doc = windows(ids, place)
        each = np.concatenate([self.score_windows(inputs[i : i + chunk], targets[i : i + chunk]) for i in range(0, len(inputs), chunk)] or [np.zeros(0)])
        return np.bincount(doc, weights=each, minlength=len(place) - 1)
