"""Toxicity of texts by a bidirectional gated recurrent network with attention over characters and words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import others
from ._words import Words, hashes, mix, pieces, words

#: Words of a window, and from one window's start to the next: neighbours share half, so each phrase of up to 33 words is whole in one.
WINDOW, STRIDE = 64, 32
#: Numbers that a word, its characters and the state of one direction have.
WORD_DIM, CHAR_DIM, STATE = 8, 8, 8
#: Rows of the tables of words and of character runs; hashes choose the row.
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
#: Bytes of a run; the first runs of a word and all its inner ones are looked up.
RUNS = (3, 4, 5)
#: Bytes of a part of a word, and from one part's start to the next: longer words are several steps of a window, and each run is whole in a part.
PART, PART_STRIDE = 48, 32
#: Labelled documents that the network learns from: at most so many of each label, those of least hash of their id.
TRAIN_PER_LABEL = 1000
#: Bytes of the texts of a label from which no further document is taken, so that what the driver holds is bounded; each is read whole.
TRAIN_BYTES = 8 << 20
EPOCHS, RATE, SEED = 4, 0.01, 7
#: Rows of the tables that fewer training documents use stay zero, in training and in scores: they tell nothing yet.
LEAST_DOCS = 3


def crc_remainder(id_col: str, folds: int = 5):
    return F.pmod(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")), F.lit(folds))


class Network:
    """Parameters and passes. A word is a row of the word table beside the mean of the rows of its character runs.

    The first number of a row isn't learned by descent: it says how much more often toxic documents have it, and of a
    word's runs the largest counts.
    """

    def __init__(self, seed: int = SEED):
        r = np.random.Generator(np.random.PCG64(seed))
        d, h = WORD_DIM + CHAR_DIM, STATE
        normal = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(WORD_ROWS, WORD_DIM, scale=0.05), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.05)}
        for side in "fb":
            self.p |= {f"{side}x": normal(d, 3 * h, scale=d**-0.5), f"{side}h": normal(h, 3 * h, scale=h**-0.5), f"{side}c": np.zeros(3 * h, np.float32)}
        self.p |= {"att": normal(2 * h, h, scale=0.3), "att_v": normal(h, scale=0.5), "out": normal(2 * h, scale=0.5), "bias": np.array([-1.0], np.float32)}

    def inputs(self, word_rows: np.ndarray, char_rows: np.ndarray, char_of: np.ndarray, n: int) -> np.ndarray:
        """Numbers of ``n`` distinct words: ``char_rows`` are rows of runs of the words ``char_of``."""
        chars = np.zeros((n, CHAR_DIM), np.float32)
        if len(char_rows):
            begins = np.flatnonzero(np.concatenate([[True], char_of[1:] != char_of[:-1]]))
            counts = np.diff(np.append(begins, len(char_of)))
            rows = self.p["char"][char_rows]
            chars[char_of[begins]] = np.add.reduceat(rows, begins, axis=0) / counts[:, None]
            chars[char_of[begins], 0] = np.maximum.reduceat(rows[:, 0], begins)
        return np.concatenate([self.p["word"][word_rows], chars], 1)

    def forward(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows. ``x``: numbers of distinct words; ``at``: (steps, windows) places in it; ``real``: not padding."""
        p, h = self.p, STATE
        steps, n = at.shape
        states, held = np.zeros((steps, n, 2 * h), np.float32), {}
        for k, side in enumerate("fb"):
            pre = x @ p[f"{side}x"] + p[f"{side}c"]
            s = np.zeros((n, h), np.float32)
            trace = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                g = pre[at[t]]
                u = s @ p[f"{side}h"]
                zr = 1 / (1 + np.exp(-(g[:, :2 * h] + u[:, :2 * h])))
                z, r = zr[:, :h] * real[t][:, None], zr[:, h:]
                c = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
                if keep:
                    trace.append((t, s, z, r, c, u[:, 2 * h:]))
                s = s + z * (c - s)  # a padded step has z = 0 and leaves the state alone
                states[t, :, k * h:(k + 1) * h] = s
            held[side] = trace
        a = np.tanh(states @ p["att"])
        e = np.where(real, a @ p["att_v"], -1e9)
        e -= e.max(0)
        w = np.exp(e)
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logits = pooled @ p["out"] + p["bias"]
        return (logits, (states, a, w, pooled, held)) if keep else logits

    def gradients(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, made, error: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of all but the tables, and of ``x``; ``error``: of each window's logit."""
        p, h = self.p, STATE
        states, a, w, pooled, held = made
        g = {"out": pooled.T @ error, "bias": np.array([error.sum()])}
        d_pooled = error[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0)) * real
        g["att_v"] = np.einsum("tn,tnh->h", d_e, a)
        d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"] = np.einsum("tni,tnj->ij", states, d_a)
        d_states = d_states + d_a @ p["att"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u_w = p[f"{side}h"]
            d_pre, g_u, d_s = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(u_w), np.zeros((at.shape[1], h), np.float32)
            for t, s, z, r, c, uc in reversed(held[side]):
                d_s = d_s + d_states[t, :, k * h:(k + 1) * h]
                d_c = d_s * z * (1 - c * c)
                on = real[t][:, None]
                d_z = d_s * (c - s) * z * (1 - z) * on
                d_r = d_c * uc * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_c], 1)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                np.add.at(d_pre, at[t], d_g)
                g_u += s.T @ d_u
                d_s = d_s * (1 - z) + d_u @ u_w.T
            g[f"{side}h"], g[f"{side}x"], g[f"{side}c"] = g_u, x.T @ d_pre, d_pre.sum(0)
            d_x += d_pre @ p[f"{side}x"].T
        return g, d_x


def steps(texts: pa.Array) -> Words:
    """The words of ``texts`` in lower case, those longer than PART bytes as overlapping parts; a word can be a whole text where nothing is blank."""
    w = words(texts, lower=True)
    length = w.end - w.start
    if not len(length) or length.max() <= PART:
        return w
    n = np.where(length > PART, -(-(length - PART) // PART_STRIDE) + 1, 1)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = w.start[of] + place * PART_STRIDE
    end = np.minimum(start + PART, w.end[of])
    hashed, cut = w.hash[of], n[of] > 1
    hashed[cut] = hashes(w.data, start[cut], end[cut], lower=True)
    hashed[place > 0] = mix(hashed[place > 0] + np.uint64(1))  # another than a word of the same bytes
    return Words(np.concatenate([[0], np.cumsum(n)])[w.first], hashed, start, end, w.data)


def vocabulary(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each distinct word, rows of character runs, the distinct word of each run, the distinct word of each word)."""
    distinct, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
    start, length = w.start[first], w.end[first] - w.start[first]
    inner = np.concatenate([[False], w.start[1:] < w.end[:-1]])[first]  # a part that isn't the first overlaps the one before
    rows, owner = [], []
    fold = w.data.astype(np.uint64)
    fold[(w.data >= 65) & (w.data <= 90)] += np.uint64(32)
    for n in RUNS:
        count = np.maximum(length - n + 1, 0)
        own = np.repeat(np.arange(len(distinct)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = start[own] + place
        value = np.zeros(len(at), np.uint64)
        for j in range(n):
            value = value * np.uint64(257) + fold[at + j]
        value = value * np.uint64(2) + ((place == 0) & ~inner[own])  # a run at the beginning of a word is another than the same inside
        rows.append((mix(value) % np.uint64(CHAR_ROWS)).astype(np.int32))
        owner.append(own.astype(np.int32))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return (mix(distinct) % np.uint64(WORD_ROWS)).astype(np.int64), rows[order], owner[order], of


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of the overlapping windows of all texts; together they cover every word."""
    counts = np.diff(w.first)
    n = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return start + w.first[doc], np.minimum(WINDOW, counts[doc] - start), doc


def _steps(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(int(size.max()) if len(size) else 0)[:, None]
    real = t < size
    return np.where(real, of[np.minimum(start + t, len(of) - 1)], 0), real


def window_logits(net: Network, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The logit of every window of the texts, and the text of each."""
    start, size, doc = windows(w)
    if not len(start):
        return np.zeros(0, np.float32), doc
    word_rows, char_rows, char_of, of = vocabulary(w)
    x = net.inputs(word_rows, char_rows, char_of, len(word_rows))
    out = np.empty(len(start), np.float32)
    for a in range(0, len(start), 4096):
        out[a:a + 4096] = net.forward(x, *_steps(start[a:a + 4096], size[a:a + 4096], of))
    return out, doc


def top_logits(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The largest logit of each text's windows; -8 for texts without words."""
    top = np.full(n_docs, -8.0)
    if len(doc):
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top[doc[begins]] = np.maximum.reduceat(logits, begins)
    return top


def _start_rows(net: Network, seen: list, y: np.ndarray) -> dict[str, np.ndarray]:
    """Sets the first numbers of the rows from the documents that have them; returns which rows are in use."""
    used = {}
    for k, part, size in (("word", 0, WORD_ROWS), ("char", 1, CHAR_ROWS)):
        have = [np.bincount(np.concatenate([np.unique(v[part]) for v, label in zip(seen, y, strict=True) if label == c]), minlength=size) for c in (0, 1)]
        odds = np.log((have[1] + 0.5) / (y.sum() + 1)) - np.log((have[0] + 0.5) / ((1 - y).sum() + 1))
        total = have[0] + have[1]
        used[k] = total >= LEAST_DOCS
        net.p[k][:, 0] = np.where(used[k], odds * total / (total + 4) / 2, 0)
        net.p[k][~used[k]] = 0
    return used


def _adam(net: Network, moments: dict, g: dict, step: int) -> None:
    scale = min(1.0, 1 / (np.sqrt(sum((v**2).sum() for v in g.values())) + 1e-9))
    for k, v in g.items():
        m, s = moments[k]
        m += 0.1 * (v * scale - m)
        s += 0.01 * ((v * scale) ** 2 - s)
        net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def _cut(top: np.ndarray, y: np.ndarray) -> float:
    """Where the two labels' logits are told apart best, each label weighing the same; in the middle of the gap there."""
    ranked = np.argsort(top, kind="stable")
    edges = np.concatenate([[top[ranked[0]] - 2], top[ranked], [top[ranked[-1]] + 2]])
    wrong = np.concatenate([[0], np.cumsum(y[ranked])]) / y.sum() + np.concatenate([np.cumsum((1 - y[ranked])[::-1])[::-1], [0]]) / (1 - y).sum()
    least = np.flatnonzero(wrong == wrong.min())
    gap = edges[least + 1] - edges[least]
    return float((edges[least] + edges[least + 1])[np.argmax(gap)] / 2)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> tuple[Network, float]:
    """A network and the shift of its logits. A text is as toxic as its most toxic window.

    Each epoch takes of every text the window that scores highest, which of a clean text is the one that most needs
    correction, and a random one of the clean. Before the first epoch the sum of the rows' first numbers stands in for
    the score. Adam for dense parameters, Adagrad for rows. A fifth of the texts is kept back to place the decision.
    """
    net = Network(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return net, 4.0 if len(y) and y.min() else -4.0
    order = np.random.Generator(np.random.PCG64(seed))
    back = np.zeros(len(y), bool)
    for c in (0, 1):
        own = order.permutation(np.flatnonzero(y == c))
        back[own[:len(own) // 5 if len(own) >= 50 else 0]] = True
    seen, cuts = [], []
    for t in texts:  # what is kept of a text is its distinct words and where its windows are, not every word's place
        w = steps(pa.array([t]))
        wr, cr, co, of = vocabulary(w)
        seen.append((wr, cr, co, of.astype(np.int32)))
        cuts.append(windows(w))
    fit = np.array([i for i in np.flatnonzero(~back) if len(cuts[i][0])])
    used = _start_rows(net, [seen[i] for i in fit], y[fit])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "char")}
    squares = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "char")}
    step, tops = 0, {}
    for epoch in range(max(epochs, min(12, 3000 // len(fit)))):
        chosen = []
        for i in fit:
            (start, size, _), (wr, cr, co, of) = cuts[i], seen[i]
            x = net.inputs(wr, cr, co, len(wr))
            if epoch == 0:
                sums = np.concatenate([[0], np.cumsum(np.maximum(x[of, 0], x[of, WORD_DIM]).clip(0.5))])
                logits = sums[start + size] - sums[start]
            elif epoch % 2 == 0 or len(fit) < 500:
                logits = net.forward(x, *_steps(start, size, of))
            else:
                logits = None
            tops[i] = int(np.argmax(logits)) if logits is not None else tops[i] if epoch else 0
            chosen.append((i, tops[i]))
            if y[i] == 0 and len(start) > 1:
                chosen.append((i, int(order.integers(len(start)))))
        chosen = [chosen[j] for j in order.permutation(len(chosen))]
        weight = {c: 0.5 * len(chosen) / max(1, sum(y[i] == c for i, _ in chosen)) for c in (0, 1)}
        for b in range(0, len(chosen), 64):
            some = chosen[b:b + 64]
            base, rows, runs, owners, places = 0, [], [], [], np.zeros((WINDOW, len(some)), np.int64)
            real = np.zeros((WINDOW, len(some)), bool)
            for j, (i, win) in enumerate(some):
                (start, size, _), (wr, cr, co, of) = cuts[i], seen[i]
                inside = of[start[win]:start[win] + size[win]]
                own, place = np.unique(inside, return_inverse=True)
                pick = np.isin(co, own)
                rows.append(wr[own])
                runs.append(cr[pick])
                owners.append(np.searchsorted(own, co[pick]) + base)
                places[:size[win], j], real[:size[win], j] = place + base, True
                base += len(own)
            rows, runs, owners = np.concatenate(rows), np.concatenate(runs), np.concatenate(owners)
            x = net.inputs(rows, runs, owners, base)
            logit, made = net.forward(x, places, real, keep=True)
            who = np.array([i for i, _ in some])
            error = ((1 / (1 + np.exp(-logit)) - y[who]) * np.array([weight[int(v)] for v in y[who]]) / len(some)).astype(np.float32)
            g, d_x = net.gradients(x, places, real, made, error)
            step += 1
            _adam(net, moments, g, step)
            counts = np.bincount(owners, minlength=base)
            for k, at, d in (("word", rows, d_x[:, 1:WORD_DIM]), ("char", runs, (d_x[:, WORD_DIM + 1:] / np.maximum(counts, 1)[:, None])[owners])):
                ids, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(ids), d.shape[1]), np.float32)
                np.add.at(total, inverse, d)
                total *= used[k][ids][:, None]
                squares[k][ids] += (total**2).mean(1)
                net.p[k][ids, 1:] -= 0.02 * total / np.sqrt(squares[k][ids])[:, None]
    judge = np.flatnonzero(back) if back.any() and 0 < y[back].sum() < back.sum() else np.arange(len(y))
    top = np.array([top_logits(*window_logits(net, steps(pa.array([texts[i]]))), 1)[0] for i in judge])
    return net, -_cut(top, y[judge])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> tuple[Network, float]:
    """A network trained on the driver from a bounded sample: TRAIN_PER_LABEL documents of each label, fewer once their whole texts reach TRAIN_BYTES.

    With ``held_out`` documents whose crc32 of the id has remainder 0 by 5 are never looked at.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    if held_out:
        known = known.where(crc_remainder(id_col) != 0)
    order = F.xxhash64(F.lit(SEED), F.col(id_col))
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(order, id_col).limit(TRAIN_PER_LABEL)
        chosen = some if chosen is None else chosen.union(some)
    chosen = F.broadcast(chosen)
    texts = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    sizes = texts.select(id_col, F.octet_length("_t").cast("long").alias("_n")).join(chosen, id_col).groupBy(id_col, "_y").agg(F.max("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_y").orderBy(order, id_col)) - F.col("_n")
    fits = sizes.withColumn("_before", before).where(F.col("_before") < TRAIN_BYTES).select(id_col, "_y")
    rows = texts.join(F.broadcast(fits), id_col).groupBy(id_col, "_y").agg(F.max("_t").alias("_t")).orderBy(order, id_col).collect()
    texts, known_labels = [r["_t"] for r in rows], [int(r["_y"]) for r in rows]
    del rows
    model = train(texts, known_labels)
    del texts
    _give_back()
    return model


def _give_back() -> None:
    """Returns the memory that training has freed to the system: the driver lives on and holds much else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def score(docs: DataFrame, model: tuple[Network, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1): of the most toxic of all overlapping windows of the whole text.

    Null and empty texts, and those without words, get the score of a window far from toxic. Equal texts have equal
    scores, repeated rows and ids among them. A column named score, in any case, is replaced. The network, a few MB whatever the input, is broadcast.
    """
    spark = docs.sparkSession
    net, shift = model
    sent = spark.sparkContext.broadcast(({k: v.astype(np.float32) for k, v in net.p.items()}, shift))
    cols = others(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p, moved = sent.value
        for batch in batches:
            texts = batch.column(cols.index(text_col))
            for lo, hi in pieces(texts):
                top = top_logits(*window_logits(own, steps(texts.slice(lo, hi - lo))), hi - lo)
                made = 1 / (1 + np.exp(-(top + moved)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(made, pa.float64())], names=[*cols, "score"])

    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols), "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, kind)
