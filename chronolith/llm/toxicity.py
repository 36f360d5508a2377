"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the sum of its own vector, if the word was learned, and of the vectors of its character n-grams
(with its two ends marked), through tanh. Two gated recurrent layers read a window of words forwards and backwards;
attention weighs their states; the weighted sum gives the window's score. All overlapping windows of a whole text
are scored, and the text's score is that of its highest window. The network is trained here, in numpy.

It is fitted on a bounded sample of labelled rows, `Sample`: the rows of each label that come first by a hash of
their id, with all windows of their whole texts. A row's label holds for the text, not for each of
its windows; so at first the windows of a toxic row share a weight, and later only its highest is learned from, and those
that score above 99 of 100 clean windows. One row in five of the sample isn't trained on: where those rows' whole texts part best by their
highest windows is the score 0.5, so that it parts texts, not windows.

Defined results: a null text, or one without a word, has the score of an empty window, which is learned to be clean
(0); null labels are not learned from; without rows of both labels every score is 0; an id labelled several times
counts with its largest label; repeated rows are scored each, alike but for rounding (single precision); an empty table gives an empty result; further columns
are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, refuse_clash, ship, stored, table, tidy, trim
from .language_id import fold

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 64, 32
EMBED, HIDDEN = 16, 8
GRAM_BITS = 18
#: Rows of the sample a word or n-gram must occur in to have a vector of its own.
LEAST_ROWS = 5
#: Bytes that separate words here: ASCII but for letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Sample:
    """Bounds of what is learned from: rows of each label; windows that a toxic row counts for at first; then the least
    number of epochs and of steps, the largest batch, the rate."""

    toxic: int = 2000
    clean: int = 3000
    counts_for: float = 5.0
    epochs: int = 4
    steps: int = 500
    batch: int = 256
    rate: float = 0.01


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram (3 and 4 bytes, ends of the word included) of some words, and its word."""
    size = (ends - starts) + 2
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(int(size.sum())) - first[word] - 1
    inner = (at >= 0) & (at < (ends - starts)[word])
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf) if len(buf) else buf
    b = np.where(at < 0, 2, 3).astype(np.uint64)
    b[inner] = low[(starts[word] + at)[inner]]
    out, owner = [], []
    for n in (3, 4):
        if len(b) >= n:
            g = np.full(len(b) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                g = g * np.uint64(257) + b[k : k + len(g)]
            good = word[: len(g)] == word[n - 1 :]
            out.append((mix(g[good]) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
            owner.append(word[: len(g)][good])
    return np.concatenate(out or [np.zeros(0, np.int64)]), np.concatenate(owner or [np.zeros(0, np.int64)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, words: np.ndarray, buckets: np.ndarray, seed: int = 7):
        """words: sorted hashes of the words that have a vector; buckets: sorted n-gram buckets that have one."""
        rng = np.random.default_rng(seed)
        self.words, self.buckets, self.zero = words, buckets, 0.0
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": draw(len(words) + 1, EMBED, scale=0.05), "gram": draw(len(buckets) + 1, EMBED, scale=0.05),
            "x": draw(EMBED, 6 * HIDDEN, scale=EMBED**-0.5), "bx": np.zeros(6 * HIDDEN, np.float32),
            "h": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "a": draw(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN) ** -0.5), "ba": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, scale=HIDDEN**-0.5),
            "w": draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "b": np.zeros(1, np.float32),
        }
        self.p["word"][0] = self.p["gram"][0] = 0  # of what was not learned
        self._place()

    def _place(self):
        self.row = np.zeros(1 << GRAM_BITS, dtype=np.int32)
        self.row[self.buckets] = np.arange(1, len(self.buckets) + 1)

    def __getstate__(self):
        return {"words": self.words, "buckets": self.buckets, "p": self.p, "zero": self.zero}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._place()

    def inputs(self, hashes: np.ndarray, bucket: np.ndarray, owner: np.ndarray):
        """Input vectors of some words, with the rows of both tables they are made of."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        word = np.where(self.words[at] == hashes, at + 1, 0) if len(self.words) else np.zeros(len(hashes), np.int64)
        row = self.row[bucket]
        known = row > 0
        row, owner = row[known], owner[known]
        order = np.argsort(owner, kind="stable")
        row, owner = row[order], owner[order]
        total = self.p["word"][word]
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            total[owner[first]] += np.add.reduceat(self.p["gram"][row], first, axis=0)
        return np.tanh(total), word, row, owner

    def forward(self, gate: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores (before the sigmoid) of windows: gate (T, B, 6 H), the input's part of the gates; mask (T, B)."""
        p, (steps, n) = self.p, mask.shape
        g = np.stack((gate[:, :, : 3 * HIDDEN], gate[::-1, :, 3 * HIDDEN :]), axis=1)  # T, 2, B, 3 H
        m = np.stack((mask, mask[::-1]), axis=1)[..., None]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            u = h @ p["h"]
            zr = _sigmoid(g[t, ..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(g[t, ..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = h + m[t] * (1 - z) * (c - h)
            if keep:
                kept.append((h, z, r, c, u[..., 2 * HIDDEN :]))
            h = new
            states[t] = h
        both = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)  # T, B, 2 H
        q = np.tanh(both @ p["a"] + p["ba"])
        e = np.where(mask > 0, q @ p["v"], np.float32(-1e9))
        weight = np.exp(e - e.max(axis=0))
        weight = weight * (mask > 0)
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        score = pooled @ p["w"] + p["b"][0]
        return (score, (g, m, kept, both, q, weight, pooled)) if keep else score

    def gradients(self, target: np.ndarray, score: np.ndarray, kept, mask: np.ndarray, counts: np.ndarray | float = 1.0) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy, where windows count as given: by all parameters but the tables and the input's, and by gate."""
        p, (g, m, steps, both, q, weight, pooled) = self.p, kept
        d = ((_sigmoid(score) - target) * counts / len(target)).astype(np.float32)
        out = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = np.outer(d, p["w"])
        dweight = np.einsum("bh,tbh->tb", dp, both)
        dboth = weight[..., None] * dp
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        dq = de[..., None] * p["v"] * (1 - q * q)
        out["v"] = np.einsum("tb,tbh->h", de, q)
        out["a"] = np.einsum("tbi,tbj->ij", both, dq)
        out["ba"] = dq.sum(axis=(0, 1))
        dboth += dq @ p["a"].T
        dstates = np.stack((dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]), axis=1)
        dh, dg = np.zeros_like(steps[0][0]), np.empty_like(g)
        out["h"] = np.zeros_like(p["h"])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, c, un = steps[t]
            dh = dh + dstates[t]
            dm = dh * m[t]
            dc = dm * (1 - z) * (1 - c * c)
            dz = -dm * (c - h) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            du = np.concatenate((dz, dr, dc * r), axis=-1)
            dg[t] = np.concatenate((dz, dr, dc), axis=-1)
            out["h"] += h.transpose(0, 2, 1) @ du
            dh = dh - dm * (1 - z) + du @ p["h"].transpose(0, 2, 1)
        return out, np.concatenate((dg[:, 0], dg[::-1, 1]), axis=-1)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            np.clip(g, -1, 1, out=g)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


class _Joined:
    """Words of many texts, hashed a run of texts at a time: bytes, starts, ends, hash, first word of each text."""

    def __init__(self, texts: list[str]):
        bufs, starts, ends, hashes, first, bytes_, words = [], [], [], [], [np.zeros(1, np.int64)], 0, 0
        for _, _, buf, offsets in chunks(pa.array(texts, pa.large_string())):
            w = Words(buf, offsets, lower=True, apart=APART)
            bufs.append(buf), starts.append(w.starts + bytes_), ends.append(w.ends + bytes_), hashes.append(w.hash), first.append(w.first[1:] + words)
            bytes_, words = bytes_ + len(buf), words + len(w.hash)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.buf, self.starts, self.ends, self.hash, self.first = join(bufs, np.uint8), join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), np.concatenate(first)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words start at `first`: first word, number of words and text of every window; every word is in one, most in two."""
    size = np.diff(first)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + nth * STRIDE
    return begin, np.minimum(WINDOW, first[text + 1] - begin), text


def learn(texts: list[str], text_labels: np.ndarray, sample: Sample, seed: int = 7) -> Network | None:
    """A network fitted on all windows of texts and the texts' labels."""
    rng = np.random.default_rng(seed)
    w = _Joined(texts)
    begin, length, rows = windows_of(w.first)
    labels = text_labels[rows]
    if len(set(labels.tolist())) < 2:
        return None
    every, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    word = word.astype(np.int32)
    parts = []
    for k in range(0, len(every), 20_000):  # so that n-grams of few words are made at once
        b, o = grams(w.buf, w.starts[first[k : k + 20_000]], w.ends[first[k : k + 20_000]])
        turn = np.argsort(o, kind="stable")
        parts.append((b[turn].astype(np.int32), (o[turn] + k).astype(np.int32)))
    bucket, owner = (np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int32) for m in (0, 1))
    # what occurs in a few rows at least has a vector of its own
    of_row = np.repeat(np.arange(len(texts)), np.diff(w.first))
    pairs = np.unique(word.astype(np.int64) * len(texts) + of_row) // len(texts)
    spread = np.bincount(pairs, minlength=len(every))
    by_bucket = np.bincount(bucket, weights=np.minimum(spread, LEAST_ROWS)[owner], minlength=1 << GRAM_BITS)
    net = Network(every[spread >= LEAST_ROWS], np.flatnonzero(by_bucket >= LEAST_ROWS), seed)
    adam = Adam(net.p, sample.rate)
    start = np.searchsorted(owner, np.arange(len(every) + 1))

    def windows(some: np.ndarray):
        """Inputs of a batch: words (T, B) as places in the batch's own words, mask."""
        place = begin[some] + np.arange(WINDOW)[:, None]
        mask = np.arange(WINDOW)[:, None] < length[some]
        mine, local = np.unique(word[np.where(mask, place, 0)], return_inverse=True)
        n = start[mine + 1] - start[mine]
        flat = np.repeat(start[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return local.reshape(mask.shape), mask.astype(np.float32), every[mine], bucket[flat], np.repeat(np.arange(len(mine)), n)

    def scores(some: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(some), 1024):
            local, mask, h, b, o = windows(some[i : i + 1024])
            x = net.inputs(h, b, o)[0]
            out.append(net.forward((x @ net.p["x"] + net.p["bx"])[local], mask))
        return np.concatenate(out)

    use = np.arange(len(begin))
    counts = np.where(labels == 1, np.minimum(1.0, sample.counts_for / np.bincount(rows)[rows]), 1.0)
    batch = int(np.clip(len(begin) // 64, 16, sample.batch))
    epochs = max(sample.epochs, -(-sample.steps * batch // len(begin)))
    for epoch in range(epochs):
        if epoch in (2 * epochs // 7, 3 * epochs // 7, 4 * epochs // 7):
            s, counts = scores(np.arange(len(begin))), np.ones(len(begin))
            top = np.zeros(len(texts), np.float32) - np.inf
            np.maximum.at(top, rows, s)
            use = np.flatnonzero((labels == 0) | (s >= top[rows]) | (s > np.quantile(s[labels == 0], 0.99)))
        adam.rate = sample.rate * (1 if epoch < epochs * 5 // 7 else 0.3)
        order = rng.permutation(use)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            local, mask, h, b, o = windows(some)
            x, word_at, row, o = net.inputs(h, b, o)
            keep = rng.random(len(word_at)) > 0.3  # words without their own vector at times: n-grams must do
            x = x if epoch == 0 else np.tanh(np.arctanh(np.clip(x, -0.999999, 0.999999)) - np.where(keep[:, None], 0, net.p["word"][word_at])).astype(np.float32)
            gate = (x @ net.p["x"] + net.p["bx"])[local]
            score, held = net.forward(gate, mask, keep=True)
            grad, dgate = net.gradients(labels[some].astype(np.float32), score, held, mask, counts[some])
            grad["bx"] = dgate.sum(axis=(0, 1))
            flat, to = dgate.reshape(-1, dgate.shape[-1]), local.reshape(-1)
            turn = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], to[turn][1:] != to[turn][:-1])))
            dx_gate = np.add.reduceat(flat[turn], edge, axis=0)  # every word of the batch occurs
            grad["x"] = x.T @ dx_gate
            du = (dx_gate @ net.p["x"].T) * (1 - x * x)
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], word_at, du * (keep[:, None] if epoch else 1))
            np.add.at(grad["gram"], row, du[o])
            grad["word"][0] = grad["gram"][0] = 0
            adam.step(grad)
    return net


def score_texts(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score, 0 to 1, of each of a run of texts by its highest window."""
    n = len(offsets) - 1
    out = np.full(n, -30.0)
    w = Words(buf, offsets, lower=True, apart=APART)
    if not len(w.hash):
        return np.zeros(n)
    every, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    x = net.inputs(every, *grams(buf, w.starts[first], w.ends[first]))[0]
    gate = x @ net.p["x"] + net.p["bx"]
    begin, length, text = windows_of(w.first)
    order = np.argsort(length, kind="stable")  # windows of like lengths together
    for i in range(0, len(order), 1024):
        some = order[i : i + 1024]
        steps = int(length[some].max())
        mask = np.arange(steps)[:, None] < length[some]
        place = np.where(mask, begin[some] + np.arange(steps)[:, None], 0)
        np.maximum.at(out, text[some], net.forward(gate[word[place]], mask.astype(np.float32)))
    return np.where(np.diff(w.first) > 0, _sigmoid(out - net.zero), 0.0)


def boundary(score: np.ndarray, label: np.ndarray, share: float) -> float:
    """The score (as a logit) that parts the labels with the least error, the middle of the widest such gap.

    share: of label 1 among all labelled rows; errors of either label are weighed by it.
    """
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    missed = np.concatenate(([0], np.cumsum(y == 1))) / max(1, (y == 1).sum()) * share
    false = (1 - np.concatenate(([0], np.cumsum(y == 0))) / max(1, (y == 0).sum())) * (1 - share)
    error = missed + false  # of a boundary below s[0], between s[0] and s[1], ..., above the last
    low, high = np.concatenate(([s[0] - 2], s)), np.concatenate((s, [s[-1] + 2]))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    k = best[np.argmax(high[best] - low[best])]
    return float((low[k] + high[k]) / 2)


@tidy
def fit(docs: DataFrame, labels: DataFrame, sample: Sample | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Trains on a bounded sample: labels (id, label) of docs. Only the sample's ids and texts come to the driver."""
    sample = sample or Sample()
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = None
    for value, most in ((1, sample.toxic), (0, sample.clean)):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    picked = [(r["id"], r["label"], k % 5 == 4) for k, r in enumerate(chosen.collect())]
    if not picked:
        return None
    picked = docs.sparkSession.createDataFrame(picked, "id bigint, label int, held boolean")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # at most toxic + clean rows
    rows = stored(rows)

    got = rows.where("not held").select("id", "label", "text").orderBy("id", "text").toArrow()
    net = learn(got["text"].to_pylist(), got["label"].to_numpy(), sample)
    trim()
    if net is not None:
        judged = toxicity(rows.where("held"), net, ["label"]).toArrow()
        p, label = np.clip(judged["score"].to_numpy(), 1e-13, 1 - 1e-13), judged["label"].to_numpy()
        if len(set(label.tolist())) == 2:
            net.zero = boundary(np.log(p / (1 - p)), label, known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0])
    return net


def toxicity(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with score, 0 to 1. The text goes to the workers once, kept or not. `keep` may not hold `score`."""
    refuse_clash(keep, ("score",))
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(net)
    docs = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = docs.columns.index(text_col)
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + ["score double"])

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                score = np.zeros(batch.num_rows)
                if held.value is not None:
                    for i, j, buf, offsets in chunks(batch.column(at)):
                        score[i:j] = score_texts(held.value, buf, offsets)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])
        trim()

    return docs.mapInArrow(run, fields)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    net = fit(docs.select("doc_id", "text"), labels)
    out = toxicity(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), net, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
