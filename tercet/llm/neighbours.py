"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors form one class (copies are never joined with each other). Classes are dealt over
blocks of about BLOCK; a table has one row for each block, with its unit vectors and neighbour lists
as arrays. In a round every class asks its sampled neighbours for their vectors (a join of blocks),
they answer, and the neighbours of one class, forward and reverse, new and old, meet: pairs nearer
than the worst neighbour that either holds are proposed to it (a second join), and the best are kept
(a third). A round is one job; rounds end when at most CHANGED of all neighbours are new in one,
however many that takes. Messages between two blocks are one row, so their number never exceeds the
edges that they carry, and no row grows with the table.

Queries start at their own class and expand the best unexpanded classes of a beam until nothing in
it is unexpanded; arcs and vectors are looked up by joins of blocks. The last ranking uses original
vectors in double precision.

Defined cases: vectors that are null, zero, of another length than most, or that hold a null or a
component that is not finite take no part, nor do rows without vec_id; equal vectors and repeated
rows are ranked by vec_id (rows that repeat a vec_id count each, none for itself); with few candidates
all are returned; one vector or an empty table give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import forget, looked_up, small_batches, sorted_positions, table, written

K = 32  #: neighbours that the graph keeps
SAMPLE = 16  #: new, old, reverse new and reverse old neighbours that meet in a round, of each
OFFERS = 6  #: proposals that a member takes from one meeting
CHANGED = 0.002  #: share of new neighbours in a round at which the graph counts as found
BLOCK = 4096  #: classes in a block
CHUNK = 128  #: classes whose neighbours meet in one matrix product
BEAM, EXPAND, ARCS = 160, 40, 2 * K  #: classes that a query holds, expands in a step, and arcs of a class
QUERY_BLOCK = 256
QUERY_EVERY, NEAREST = 50, 5
SEED = 11

STATE = "block int, x binary, ids binary, sims binary, fresh binary, moved long"
MAIL = "to int, kind int, a binary, b binary, f binary, keys binary, x binary, worst binary"
ANSWER, REVERSE = 0, 1
_MAIL = [part.split()[0] for part in MAIL.split(", ")]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    held = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    held = held.filter(F.exists("v", lambda x: x != 0))
    size = held.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return held.filter(F.size("v") == (size["size"] if size else 0))


# arrays in and out of binary columns


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32)


def _flags(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, bool)


def _vectors(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float16).reshape(rows, -1) if rows else np.zeros((0, 1), np.float16)


def _mail(to: int, kind: int, a=None, b=None, f=None, keys=None, x=None, worst=None) -> tuple:
    return (int(to), kind, *(None if v is None else np.ascontiguousarray(v).tobytes() for v in (a, b, f, keys, x, worst)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_MAIL)


class _Block:
    """The lists of one block: class number = local number * blocks + block."""

    def __init__(self, row: pd.Series, n_blocks: int):
        self.number, self.n_blocks = int(row["block"]), n_blocks
        self.sims = _floats(row["sims"]).reshape(-1, K)
        self.m = len(self.sims)
        self.ids, self.fresh = _longs(row["ids"]).reshape(-1, K), _flags(row["fresh"]).reshape(-1, K)
        self.x = _vectors(row["x"], self.m)
        self.own = np.arange(self.m) * n_blocks + self.number

    def worst(self) -> np.ndarray:
        return np.where((self.ids >= 0).all(axis=1), self.sims.min(axis=1), np.float32(-2))

    def sampled(self, step: int) -> np.ndarray:
        """Mask of the neighbours that meet this round: up to SAMPLE new and as many old of each class; the same whenever asked."""
        dice = np.random.default_rng((SEED, step, self.number)).random(self.ids.shape)
        chosen = np.zeros(self.ids.shape, bool)
        for kind in (self.fresh, ~self.fresh):
            key = np.where(kind & (self.ids >= 0), dice, 2.0)
            first = np.argpartition(key, min(SAMPLE, K) - 1, axis=1)[:, :SAMPLE]
            np.put_along_axis(chosen, first, np.take_along_axis(key, first, 1) < 2, 1)
        return chosen


def _ask(block: _Block, step: int) -> list[tuple]:
    """Messages to the blocks of the sampled neighbours: edges, and the asking classes' vectors."""
    row, place = np.nonzero(block.sampled(step))
    u, f = block.ids[row, place], block.fresh[row, place]
    to = u % block.n_blocks
    order = np.argsort(to, kind="stable")
    edges, worst, out = np.searchsorted(to[order], np.arange(block.n_blocks + 1)), block.worst(), []
    for target in range(block.n_blocks):
        part = order[edges[target] : edges[target + 1]]
        if len(part):
            mine = np.unique(row[part])
            out.append(_mail(target, block.number, block.own[row[part]], u[part], f[part], block.own[mine], block.x[mine], worst[mine]))
    return out


def _answer(block: _Block, asked: pd.DataFrame, step: int) -> list[tuple]:
    """To every asking block the vectors that it asked for; to the own block a sample of who asked."""
    out, worst = [], block.worst()
    if not len(asked):
        return out
    for origin, raw in zip(asked["kind"], asked["b"], strict=True):
        keys = np.unique(_longs(raw))
        local = keys // block.n_blocks
        out.append(_mail(origin, ANSWER, keys=keys, x=block.x[local], worst=worst[local]))
    asked = asked.sort_values("kind")
    v, u, f = (np.concatenate([read(r) for r in asked[c]]) for c, read in (("a", _longs), ("b", _longs), ("f", _flags)))
    dice = np.random.default_rng((SEED, step, block.number, 1)).random(len(u))
    order = np.lexsort((dice, f, u))
    group = np.flatnonzero(np.r_[True, (np.diff(u[order]) != 0) | (np.diff(f[order].astype(np.int8)) != 0)])
    rank = np.arange(len(u)) - np.repeat(group, np.diff(np.append(group, len(u))))
    kept = order[rank < SAMPLE]
    keys = np.concatenate([_longs(r) for r in asked["keys"]])
    x = np.concatenate([_vectors(r, len(_longs(k))) for r, k in zip(asked["x"], asked["keys"], strict=True)])
    theirs = np.concatenate([_floats(r) for r in asked["worst"]])
    by = np.argsort(keys)
    wanted = np.unique(v[kept])
    at = by[np.searchsorted(keys[by], wanted)]
    out.append(_mail(block.number, REVERSE, u[kept], v[kept], f[kept], wanted, x[at], theirs[at]))
    return out


def _lists(owner: np.ndarray, member: np.ndarray, m: int, width: int) -> np.ndarray:
    """Members by owner in rows of ``width``, -1 where none."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    first = np.searchsorted(owner, np.arange(m))
    out = np.full((m, width), -1, np.int64)
    out[owner, np.arange(len(owner)) - first[owner]] = member[order]
    return out


def _best(p: np.ndarray, q: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (p, q) once, and of every p the ``most`` nearest."""
    order = np.lexsort((q, p))
    p, q, s = p[order], q[order], s[order]
    once = np.r_[True, (np.diff(p) != 0) | (np.diff(q) != 0)] if len(p) else np.zeros(0, bool)
    p, q, s = p[once], q[once], s[once]
    order = np.lexsort((-s, p))
    p, q, s = p[order], q[order], s[order]
    first = np.flatnonzero(np.r_[True, np.diff(p) != 0]) if len(p) else np.zeros(0, np.int64)
    kept = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p)))) < most
    return p[kept], q[kept], s[kept]


def _meet(block: _Block, mail: pd.DataFrame, step: int) -> list[tuple]:
    """The local joins of one block's classes: proposals by the block that they go to."""
    row, place = np.nonzero(block.sampled(step))
    owner, member, fresh = [row], [block.ids[row, place]], [block.fresh[row, place]]
    back = mail[mail["kind"] == REVERSE]
    for a, b, f in zip(back["a"], back["b"], back["f"], strict=True):
        owner.append(_longs(a) // block.n_blocks)
        member.append(_longs(b))
        fresh.append(_flags(f))
    if step == 0:  # the first sims are those between a class and its random neighbours
        owner.append(np.arange(block.m))
        member.append(block.own)
        fresh.append(np.ones(block.m, bool))
    owner, member, fresh = np.concatenate(owner), np.concatenate(member), np.concatenate(fresh)
    keys = np.concatenate([block.own, *[_longs(r) for r in mail["keys"]]])
    x = np.concatenate([block.x, *[_vectors(r, len(_longs(k))) for r, k in zip(mail["x"], mail["keys"], strict=True)]])
    worst = np.concatenate([block.worst(), *[_floats(r) for r in mail["worst"]]])
    keys, first = np.unique(keys, return_index=True)
    x, worst = np.concatenate((x[first].astype(np.float32), np.zeros((1, x.shape[1]), np.float32))), np.append(worst[first], np.float32(9))
    at = np.searchsorted(keys, member)
    new = _lists(owner[fresh], at[fresh], block.m, 2 * SAMPLE + 1)
    old = _lists(owner[~fresh], at[~fresh], block.m, 2 * SAMPLE)
    ps, qs, ss = [], [], []
    for low in range(0, block.m, CHUNK):
        n, every = new[low : low + CHUNK], np.concatenate((new[low : low + CHUNK], old[low : low + CHUNK]), axis=1)
        sim = np.matmul(x[n], x[every].transpose(0, 2, 1))
        sim[(n[:, :, None] == every[:, None, :]) | (every[:, None, :] < 0)] = -3
        back_ = sim[:, :, n.shape[1] :].transpose(0, 2, 1)
        for mine, other, s in ((n, every, sim), (every[:, n.shape[1] :], n, back_)):
            s = s.reshape(-1, s.shape[2])
            best = np.argpartition(s, -OFFERS, axis=1)[:, -OFFERS:]
            got = np.take_along_axis(s, best, 1)
            who = mine.reshape(-1)
            i, j = np.nonzero((got > worst[who][:, None]) & (got > -3))
            ps.append(who[i])
            qs.append(other[i // mine.shape[1], best[i, j]])
            ss.append(got[i, j])
    p, q, s = np.concatenate(ps), np.concatenate(qs), np.concatenate(ss)
    sound = q >= 0
    p, q, s = _best(p[sound], q[sound], s[sound], K)
    p, q = keys[p], keys[q]
    to = p % block.n_blocks
    order = np.argsort(to, kind="stable")
    edges, out = np.searchsorted(to[order], np.arange(block.n_blocks + 1)), []
    for target in range(block.n_blocks):
        part = order[edges[target] : edges[target + 1]]
        if len(part):
            out.append(_mail(target, ANSWER, p[part], q[part], worst=s[part]))
    return out


def _improved(block: _Block, mail: pd.DataFrame, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Lists after the round: ids, sims, fresh, and how many neighbours are new."""
    fresh = block.fresh & ~block.sampled(step)
    row, place = np.nonzero(block.ids >= 0)
    p, q, s, f = [row], [block.ids[row, place]], [block.sims[row, place]], [fresh[row, place]]
    for a, b, sim in zip(mail["a"], mail["b"], mail["worst"], strict=True):
        p.append(_longs(a) // block.n_blocks)
        q.append(_longs(b))
        s.append(_floats(sim))
        f.append(np.ones(len(s[-1]), bool))
    held = np.concatenate([np.full(len(part), i == 0) for i, part in enumerate(p)])
    p, q, s, f = np.concatenate(p), np.concatenate(q), np.concatenate(s), np.concatenate(f)
    order = np.lexsort((s <= -2, ~held, q, p))  # of a pair the held one, but one with a sim before one without
    p, q, s, f, held = p[order], q[order], s[order], f[order], held[order]
    once = np.r_[True, (np.diff(p) != 0) | (np.diff(q) != 0)] if len(p) else np.zeros(0, bool)
    known = np.maximum.reduceat(s, np.flatnonzero(once)) if len(s) else s
    p, q, s, f, held = p[once], q[once], known, f[once], held[once]
    order = np.lexsort((q, -s, p))
    p, q, s, f, held = p[order], q[order], s[order], f[order], held[order]
    first = np.searchsorted(p, np.arange(block.m))
    rank = np.arange(len(p)) - first[p]
    kept = rank < K
    at = (p[kept], rank[kept])
    ids, sims, news = np.full((block.m, K), -1, np.int64), np.full((block.m, K), -2, np.float32), np.zeros((block.m, K), bool)
    ids[at], sims[at], news[at] = q[kept], s[kept], f[kept]
    return ids, sims, news, int((~held[kept]).sum())


def _start(number: int, x: np.ndarray, n: int, n_blocks: int) -> tuple:
    """A block's first row: random neighbours."""
    m = len(x)
    own = np.arange(m) * n_blocks + number
    ids = np.random.default_rng((SEED, number)).integers(0, n, (m, K))
    ids.sort(axis=1)
    ids[(ids == own[:, None]) | np.concatenate((np.zeros((m, 1), bool), ids[:, 1:] == ids[:, :-1]), axis=1)] = -1
    return number, x.tobytes(), ids.astype(np.int64).tobytes(), np.full((m, K), -2, np.float32).tobytes(), (ids >= 0).tobytes(), m * K


def _joined(state: DataFrame, mail: DataFrame, work, schema: str) -> DataFrame:
    """Give every block its row and its mail; ``work(block row, mail)`` returns rows of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(rows: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(work(rows.iloc[0], letters) if len(rows) else [], columns=names)

    return state.groupBy("block").cogroup(mail.groupBy("to")).applyInPandas(run, schema)


def blocks_of(classes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """First state of ``classes(c, v)``: their unit vectors (float16) and random neighbours by block."""
    n_blocks = max(1, -(-n // BLOCK))

    def start(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c")
        x = np.stack(f["v"].to_list())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame([_start(int(key[0]), x.astype(np.float16), n, n_blocks)], columns=[part.split()[0] for part in STATE.split(", ")])

    block = F.pmod(F.col("c"), F.lit(n_blocks)).cast("int")
    return written(classes.select(block.alias("block"), "c", "v").groupBy("block").applyInPandas(start, STATE), "graph"), n_blocks


def build_graph(state: DataFrame, n: int, n_blocks: int) -> DataFrame:
    """Rounds over the blocks' rows until few neighbours change."""
    step, moved = 0, n * K
    while n > 1 and moved > CHANGED * n * K:

        def asked(frames, step=step):
            for f in frames:
                for _, row in f.iterrows():
                    yield _frame(_ask(_Block(row, n_blocks), step))

        def improved(row, mail, step=step):
            block = _Block(row, n_blocks)
            ids, sims, fresh, new = _improved(block, mail, step)
            return [(block.number, row["x"], ids.tobytes(), sims.tobytes(), fresh.tobytes(), new)]

        questions = state.mapInPandas(asked, MAIL)
        answers = _joined(state, questions, lambda row, mail, step=step: _answer(_Block(row, n_blocks), mail, step), MAIL)
        offers = _joined(state, answers, lambda row, mail, step=step: _meet(_Block(row, n_blocks), mail, step), MAIL)
        new = written(_joined(state, offers, improved, STATE), "graph")
        step, moved = step + 1, new.agg(F.sum("moved")).first()[0]
        forget(state)
        state = new
    return state


# search: blocks of queries hold beams; blocks of classes hold arcs and vectors

BEAMS = "block int, q binary, x binary, ids binary, sims binary, done binary, open long"
STORE = "block int, x binary, arcs binary, places binary"


def _reverse_arcs(block: _Block) -> list[tuple]:
    row, place = np.nonzero(block.ids >= 0)
    u, to = block.ids[row, place], block.ids[row, place] % block.n_blocks
    return [_mail(t, block.number, block.own[row[to == t]], u[to == t]) for t in np.unique(to)]


def _store(block: _Block, mail: pd.DataFrame) -> list[tuple]:
    """Arcs of the classes, own neighbours first, then who holds the class as one."""
    mail = mail.sort_values("kind")
    row, place = np.nonzero(block.ids >= 0)
    owner = np.concatenate([row, *[_longs(b) // block.n_blocks for b in mail["b"]]])
    arcs = np.concatenate([block.ids[row, place], *[_longs(a) for a in mail["a"]]])
    order = np.lexsort((np.arange(len(owner)), arcs, owner))
    once = order[np.r_[True, (np.diff(owner[order]) != 0) | (np.diff(arcs[order]) != 0)]] if len(order) else order
    once.sort()
    owner, arcs = owner[once], arcs[once]
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(block.m))
    kept = order[np.arange(len(order)) - first[owner[order]] < ARCS]
    ends = np.cumsum(np.bincount(owner[kept], minlength=block.m))
    return [(block.number, block.x.tobytes(), arcs[kept].tobytes(), np.concatenate(([0], ends)).tobytes())]


class _Beams:
    def __init__(self, row: pd.Series):
        self.number, self.q = int(row["block"]), _longs(row["q"])
        self.n = len(self.q)
        self.x = _vectors(row["x"], self.n)
        self.ids, self.sims, self.done = _longs(row["ids"]).reshape(self.n, -1), _floats(row["sims"]).reshape(self.n, -1), _flags(row["done"]).reshape(self.n, -1)

    def front(self) -> np.ndarray:
        """Mask of the nearest EXPAND that are not expanded yet, of each query (lists are in order of nearness)."""
        waiting = (self.ids >= 0) & ~self.done
        return waiting & (np.cumsum(waiting, axis=1) <= EXPAND)

    def asking(self, n_blocks: int) -> list[tuple]:
        row, place = np.nonzero(self.front())
        u, to = self.ids[row, place], self.ids[row, place] % n_blocks
        out, floor = [], self.sims.min(axis=1)
        for t in np.unique(to):
            part = np.flatnonzero(to == t)
            who = np.unique(row[part])
            out.append(_mail(t, self.number, row[part], u[part], keys=who, x=self.x[who], worst=floor[who]))
        return out

    def merged(self, mail: pd.DataFrame) -> tuple:
        done = self.done | self.front()
        row, place = np.nonzero(self.ids >= 0)
        q = np.concatenate([row, *[_longs(a) for a in mail["a"]]])
        u = np.concatenate([self.ids[row, place], *[_longs(b) for b in mail["b"]]])
        s = np.concatenate([self.sims[row, place], *[_floats(w) for w in mail["worst"]]])
        d = np.concatenate([done[row, place], np.zeros(len(q) - len(row), bool)])
        order = np.lexsort((~d, u, q))
        q, u, s, d = q[order], u[order], s[order], d[order]
        once = np.r_[True, (np.diff(q) != 0) | (np.diff(u) != 0)]
        q, u, s, d = q[once], u[once], s[once], d[once]
        order = np.lexsort((u, -s, q))
        q, u, s, d = q[order], u[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]
        kept = rank <= BEAM
        at = (q[kept], rank[kept])
        ids, sims, flags = np.full((self.n, BEAM + 1), -1, np.int64), np.full((self.n, BEAM + 1), -2, np.float32), np.zeros((self.n, BEAM + 1), bool)
        ids[at], sims[at], flags[at] = u[kept], s[kept], d[kept]
        return self.number, self.q.tobytes(), self.x.tobytes(), ids.tobytes(), sims.tobytes(), flags.tobytes(), int(((ids >= 0) & ~flags).sum())


def _followed(row: pd.Series, mail: pd.DataFrame, n_blocks: int) -> list[tuple]:
    """Arcs of the asked classes, sent on to the blocks of their ends with the asking queries' vectors."""
    arcs, ends, out = _longs(row["arcs"]), _longs(row["places"]), []
    for origin, a, b, keys, x, worst in zip(*(mail[c] for c in ("kind", "a", "b", "keys", "x", "worst")), strict=True):
        q, local, keys, worst = _longs(a), _longs(b) // n_blocks, _longs(keys), _floats(worst)
        x, size = _vectors(x, len(keys)), ends[local + 1] - ends[local]
        at = np.repeat(ends[local] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = np.unique(np.stack((np.repeat(q, size), arcs[at])), axis=1)
        to = pairs[1] % n_blocks
        for t in np.unique(to):
            q_, w = pairs[0][to == t], pairs[1][to == t]
            who = np.unique(q_)
            where = np.searchsorted(keys, who)
            out.append(_mail(t, origin, q_, w, keys=who, x=x[where], worst=worst[where]))
    return out


def _scored(row: pd.Series, mail: pd.DataFrame, n_blocks: int) -> list[tuple]:
    """Sims of the asked pairs that beat the query's beam, back to the queries' blocks."""
    m, out = len(_longs(row["places"])) - 1, []
    vectors = _vectors(row["x"], m)
    for origin, letters in mail.groupby("kind"):
        q, w = (np.concatenate([_longs(r) for r in letters[c]]) for c in ("a", "b"))
        pairs = np.unique(np.stack((q, w)), axis=1)
        keys = np.concatenate([_longs(r) for r in letters["keys"]])
        keys, first = np.unique(keys, return_index=True)
        x = np.concatenate([_vectors(r, len(_longs(k))) for r, k in zip(letters["x"], letters["keys"], strict=True)])[first].astype(np.float32)
        floor = np.concatenate([_floats(r) for r in letters["worst"]])[first]
        by, local = np.searchsorted(keys, pairs[0]), pairs[1] // n_blocks
        sim = np.concatenate([np.einsum("nd,nd->n", x[by[i : i + 20_000]], vectors[local[i : i + 20_000]].astype(np.float32)) for i in range(0, len(by), 20_000)] or [np.zeros(0, np.float32)])
        better = sim > floor[by]
        if better.any():
            out.append(_mail(origin, ANSWER, pairs[0][better], pairs[1][better], worst=sim[better]))
    return out


def search(queries: DataFrame, state: DataFrame, n_blocks: int) -> DataFrame:
    """Greedy beam search of query classes ``queries(q)``: their final BEAMS."""

    def turned(frames):
        for f in frames:
            for _, row in f.iterrows():
                yield _frame(_reverse_arcs(_Block(row, n_blocks)))

    store = written(_joined(state, state.mapInPandas(turned, MAIL), lambda row, mail: _store(_Block(row, n_blocks), mail), STORE), "store")

    def vectors_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Query classes of one block, beside the row that holds their vectors."""
        x = rows["x"].dropna().iloc[0]
        q = np.unique(rows["q"].dropna().to_numpy(np.int64))
        x = _vectors(x, int(rows["m"].max()))[q // n_blocks]
        out = []
        for i in range(0, len(q), QUERY_BLOCK):
            part = q[i : i + QUERY_BLOCK]
            ids, sims = np.full((len(part), BEAM + 1), -1, np.int64), np.full((len(part), BEAM + 1), -2, np.float32)
            ids[:, 0], sims[:, 0] = part, 3
            out.append((int(key[0]) + n_blocks * (i // QUERY_BLOCK), part.tobytes(), x[i : i + QUERY_BLOCK].tobytes(), ids.tobytes(), sims.tobytes(), np.zeros(ids.shape, bool).tobytes(), len(part)))
        return pd.DataFrame(out, columns=[part.split()[0] for part in BEAMS.split(", ")])

    asking = queries.select(F.pmod("q", F.lit(n_blocks)).cast("int").alias("block"), F.col("q").cast("long").alias("q"), F.lit(None).cast("binary").alias("x"), F.lit(0).cast("long").alias("m"))
    holding = store.select("block", F.lit(None).cast("long").alias("q"), "x", (F.octet_length("places") / 8 - 1).cast("long").alias("m"))
    beams = written(asking.unionByName(holding).groupBy("block").applyInPandas(vectors_of, BEAMS), "beams")
    while beams.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]:

        def fronts(frames):
            for f in frames:
                for _, row in f.iterrows():
                    yield _frame(_Beams(row).asking(n_blocks))

        followed = _joined(store, beams.filter("open > 0").mapInPandas(fronts, MAIL), lambda row, mail: _followed(row, mail, n_blocks), MAIL)
        scored = _joined(store, followed, lambda row, mail: _scored(row, mail, n_blocks), MAIL)
        new = written(_joined(beams, scored, lambda row, mail: [_Beams(row).merged(mail)], BEAMS), "beams")
        forget(beams)
        beams = new
    forget(store)
    return beams


def found_classes(beams: DataFrame, most: int) -> DataFrame:
    """(q, c) of the ``most`` nearest classes of every query class, itself included."""

    def listed(frames):
        for f in frames:
            for _, row in f.iterrows():
                b = _Beams(row)
                ids = b.ids[:, : most + 1]
                yield pd.DataFrame({"q": np.repeat(b.q, ids.shape[1])[ids.ravel() >= 0], "c": ids.ravel()[ids.ravel() >= 0]})

    return beams.mapInPandas(listed, "q long, c long")


def nearest(vectors: DataFrame, is_query: Column, nearest_n: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row, its own row left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    held = written(usable(vectors).withColumns({"h1": F.xxhash64("v", F.lit(1)), "h2": F.xxhash64("v", F.lit(2))}), "vectors")
    # of equal vectors only the first rows can be among the nearest; the window keeps them before it shuffles
    first = written(held.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("place") <= nearest_n + 1), "first")
    placed, before = sorted_positions(first.filter("place = 1").select("vec_id", "h1", "h2"), [F.col("vec_id"), F.col("h1"), F.col("h2")], "classes")
    classes = placed.select((F.col("_row") + looked_up(before, F.col("_pid"))).alias("c"), "h1", "h2")
    n = placed.count()
    members = written(first.join(classes, ["h1", "h2"]).select("c", "place", "vec_id", "v"), "members")
    asked = written(held.filter(is_query).join(classes, ["h1", "h2"]).select(F.col("c").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "queries")
    state, n_blocks = blocks_of(members.filter("place = 1"), n)
    state = build_graph(state, n, n_blocks)
    close = found_classes(search(asked.select("q").distinct(), state, n_blocks), 4 * nearest_n)
    pairs = asked.join(close, "q").join(members, "c").filter("vec_id != query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", (dot("qv", "v") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("v", "v")))).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= nearest_n).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(QUERY_EVERY)) == 0)
