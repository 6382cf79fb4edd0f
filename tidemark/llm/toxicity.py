"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingling import blocks, word_hashes
from tidemark.llm.tokens import utf8
from tidemark.plans.scratch import cut, release

#: Words of a window, and by how many the next one starts later: every word but at the ends is in two windows.
WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH, GRAMS = 8, 8, 1 << 14
#: Labelled rows of each label that training reads at most, their bytes together, and those of a piece of a long text.
SAMPLE_ROWS, SAMPLE_BYTES, SEGMENT = 1200, 32 << 20, 2048
#: Windows that the network takes at once.
AT_ONCE = 1024
VOCABULARY = 8192
#: Passes over the sample, and more on a small one until so many steps are made.
EPOCHS, STEPS, BATCH = 6, 240, 128
FOLDS = 5

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, still UTF-8."""
    out = _LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[upper] += 0x20
    return out


class Words:
    """The words of a block of texts: runs of letters and digits, lower-cased."""

    def __init__(self, texts: list[bytes]):
        data = _lowered(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = _LETTER[data]
        steps = np.diff(inside)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        hashes = word_hashes(data, starts, ends)
        self.firsts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        self.hashes, some, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.lengths, self.data = starts[some], (ends - starts)[some], data

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, firsts): of each distinct word the hashed 4-byte sequences of ^word$$, as many as its bytes."""
        padded = self.lengths + 3
        begins = np.cumsum(padded) - padded
        text = np.full(int(padded.sum()) + 3, ord("$"), np.uint8)
        place = np.arange(int(self.lengths.sum())) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        text[begins] = ord("^")
        text[np.repeat(begins + 1, self.lengths) + place] = self.data[np.repeat(self.starts, self.lengths) + place]
        wide = text.astype(np.uint32)
        four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        bucket = (four * np.uint32(0x9E3779B1)) >> np.uint32(18)
        return bucket[np.repeat(begins, self.lengths) + place].astype(np.int64), np.cumsum(self.lengths) - self.lengths


class Windows:
    """Windows of texts as rows of word numbers; the number after the last word stands for none."""

    def __init__(self, words: Words):
        counts = np.diff(words.firsts)
        per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        self.doc = np.repeat(np.arange(len(counts)), per)
        turn = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        at = (words.firsts[:-1][self.doc] + turn * STRIDE)[:, None] + np.arange(WINDOW)
        none = len(words.hashes)
        inside = at < words.firsts[1:][self.doc][:, None]
        self.words = np.full(at.shape, none, np.int64)
        self.words[inside] = words.of[at[inside]]
        self.inside = inside
        self.firsts = np.cumsum(per) - per


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Word and character inputs, a gated recurrent layer each way, attention over the steps, one logit a window.

    A word's input is the vector of the word, if it is in the vocabulary, the mean of the vectors of its 4-byte
    sequences, and a vector of its first four bytes.
    """

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by=0.1: draw.normal(0, by, shape).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": normal(len(vocabulary) + 2, WIDTH), "gram": normal(GRAMS, WIDTH), "head": normal(GRAMS, WIDTH)}
        for way in "fb":
            self.p[f"x{way}"] = normal(3 * WIDTH, 3 * HIDDEN, by=0.3)
            self.p[f"h{way}"] = normal(HIDDEN, 3 * HIDDEN, by=0.3)
            self.p[f"b{way}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"attend": normal(2 * HIDDEN, by=0.3), "out": normal(2 * HIDDEN, by=0.5), "bias": np.zeros(1, np.float32), "scale": np.array([1, 0], np.float32)}

    def inputs(self, words: Words) -> tuple[np.ndarray, tuple]:
        """The input vector of each distinct word and of none, and where its parts came from."""
        place = np.searchsorted(self.vocabulary, words.hashes)
        known = np.zeros(len(place), bool)
        known[place < len(self.vocabulary)] = self.vocabulary[place[place < len(self.vocabulary)]] == words.hashes[place < len(self.vocabulary)]
        ids = np.where(known, place, len(self.vocabulary))
        grams, firsts = words.grams()
        x = np.zeros((len(ids) + 1, 3 * WIDTH), np.float32)
        x[:-1, :WIDTH] = self.p["word"][ids]
        x[-1, :WIDTH] = self.p["word"][-1]
        if len(ids):
            second = grams[np.minimum(firsts + 1, len(grams) - 1)]
            x[:-1, WIDTH : 2 * WIDTH] = np.add.reduceat(self.p["gram"][grams], firsts) / words.lengths[:, None]
            x[:-1, 2 * WIDTH :] = self.p["head"][second]
        else:
            second = grams
        return x, (ids, grams, firsts, words.lengths, second)

    def _steps(self, gates: np.ndarray, words: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        h = np.zeros((len(words), HIDDEN), np.float32)
        out = np.empty((WINDOW, len(words), HIDDEN), np.float32)
        u = self.p[f"h{way}"]
        for t in range(WINDOW) if way == "f" else reversed(range(WINDOW)):
            x, q = gates[words[:, t]], h @ u
            zr = x[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, qc = zr[:, :HIDDEN], zr[:, HIDDEN:], q[:, 2 * HIDDEN :]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * qc)
            if keep is not None:
                keep.append((t, h, z, r, c, qc))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, words: np.ndarray, inside: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        tape = {w: [] if keep is not None else None for w in "fb"}
        with np.errstate(over="ignore"):
            both = [self._steps(x @ self.p[f"x{w}"] + self.p[f"b{w}"], words, w, tape[w]) for w in "fb"]
        h = np.concatenate(both, axis=2)
        scores = np.where(inside.T, h @ self.p["attend"], -1e9)
        weight = np.exp(scores - scores.max(axis=0)) * inside.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"tape": tape, "h": h, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, x: np.ndarray, w: Windows) -> np.ndarray:
        """The logits of any number of windows."""
        return np.concatenate([self.forward(x, w.words[a : a + AT_ONCE], w.inside[a : a + AT_ONCE]) for a in range(0, len(w.words), AT_ONCE)])

    def gradients(self, x: np.ndarray, origin: tuple, words: np.ndarray, inside: np.ndarray, target: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        slope = (_sigmoid(self.forward(x, words, inside, keep)) - target) * cost / len(target)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, weight = keep["h"], keep["weight"]
        g["bias"][0], g["out"] = slope.sum(), keep["pooled"].T @ slope
        pooled = slope[:, None] * self.p["out"]
        alpha = (h * pooled).sum(axis=2)
        scores = weight * (alpha - (weight * alpha).sum(axis=0))
        g["attend"] = np.tensordot(scores, h, ([0, 1], [0, 1]))
        dh_all = weight[:, :, None] * pooled + scores[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, back = self.p[f"h{way}"], np.zeros((len(words), HIDDEN), np.float32)
            of_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, before, z, r, c, qc in reversed(keep["tape"][way]):
                d = dh_all[t][:, k * HIDDEN : (k + 1) * HIDDEN] + back
                dc = d * z * (1 - c * c)
                dz, dr = d * (c - before) * z * (1 - z), dc * qc * r * (1 - r)
                dq = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"h{way}"] += before.T @ dq
                back = d * (1 - z) + dq @ u.T
                np.add.at(of_word, words[:, t], np.concatenate([dz, dr, dc], axis=1))
            g[f"b{way}"] = of_word.sum(axis=0)
            g[f"x{way}"] = x.T @ of_word
            dx += of_word @ self.p[f"x{way}"].T
        ids, grams, firsts, lengths, second = origin
        np.add.at(g["word"], ids, dx[:-1, :WIDTH])
        g["word"][-1] += dx[-1, :WIDTH]
        np.add.at(g["gram"], grams, np.repeat(dx[:-1, WIDTH : 2 * WIDTH] / lengths[:, None], lengths, axis=0))
        np.add.at(g["head"], second, dx[:-1, 2 * WIDTH :])
        return g

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text: of its highest window, so that length doesn't thin out what one passage says."""
        out = np.zeros(len(texts))
        for lo, hi in blocks(texts):
            words = Words(texts[lo:hi])
            w = Windows(words)
            x, _ = self.inputs(words)
            logits = self.logits(x, w)
            out[lo:hi] = np.maximum.reduceat(logits, w.firsts)
        scale, shift = self.p["scale"]
        return _sigmoid(scale * out + shift)


def _log_odds(present: list[np.ndarray], toxic: np.ndarray, n: int) -> np.ndarray:
    """For each number below n the smoothed log-odds of being in toxic against other texts."""
    counts = np.ones((2, n)) * 0.5
    for ids, y in zip(present, toxic, strict=True):
        counts[int(y)][ids] += 1
    totals = np.array([[(toxic == 0).sum() + 1], [(toxic == 1).sum() + 1]])
    rate = counts / totals
    return np.clip(np.log(rate[1] / rate[0]), -3, 3).astype(np.float32)


def train(texts: list[bytes], toxic: np.ndarray, of_all: tuple[int, int] | None = None, seed: int = 11) -> Network:
    """Fit the network to labelled texts.

    Windows have no labels of their own: in each epoch a toxic text teaches by its highest window, and another by its
    two highest and a random one. The first number of each word, sequence and head vector starts as log-odds
    over the labelled texts. At the end a scale and shift of the highest logits are fitted, with clean and toxic texts
    weighing as many as of_all says that there are among all labels.
    """
    draw = np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to tell apart: all are like the sample
        net = Network(np.zeros(0, np.uint64), seed)
        net.p["out"][:] = 0
        net.p["bias"][0] = 4.0 if len(texts) and toxic.all() else -4.0
        return net
    words = Words(texts)
    w = Windows(words)
    grams, firsts = words.grams()
    of_docs = [np.unique(words.of[a:b]) for a, b in zip(words.firsts, words.firsts[1:], strict=False)]
    docs_with = np.bincount(np.concatenate([*of_docs, np.zeros(0, np.int64)]), minlength=len(words.hashes))
    common = np.argsort(-docs_with, kind="stable")[:VOCABULARY]
    common = np.sort(common[docs_with[common] >= 3])
    net = Network(words.hashes[common], seed)
    second = grams[np.minimum(firsts + 1, len(grams) - 1)]
    ends = firsts + words.lengths
    spread = lambda d: np.unique(np.concatenate([grams[firsts[i] : ends[i]] for i in d] or [np.zeros(0, np.int64)]))
    net.p["word"][:-2, 0] = _log_odds(of_docs, toxic, len(words.hashes))[common]
    net.p["gram"][:, 0] = _log_odds([spread(d) for d in of_docs], toxic, GRAMS)
    net.p["head"][:, 0] = _log_odds([second[d] for d in of_docs], toxic, GRAMS)

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, rate = 0, 0.02
    x, _ = net.inputs(words)
    hint = x[:, 0] + 2 * x[:, WIDTH] + x[:, 2 * WIDTH]
    logits = np.where(w.inside, hint[w.words], -9).max(axis=1)
    last = np.append(w.firsts[1:], len(w.words))
    epochs = min(60, max(EPOCHS, -(-STEPS * BATCH // (2 * len(texts)))))
    for _ in range(epochs):
        chosen, target = [], []
        for y, a, b in zip(toxic.tolist(), w.firsts.tolist(), last.tolist(), strict=True):
            order = a + np.argsort(-logits[a:b], kind="stable")
            picks = order[:1] if y else np.unique([*order[:2], draw.integers(a, b)])
            chosen += list(picks)
            target += [y] * len(picks)
        chosen, target = np.array(chosen), np.array(target, np.float32)
        mix = draw.permutation(len(chosen))
        for at in range(0, len(mix), BATCH):
            pick = mix[at : at + BATCH]
            step += 1
            numbers, compact = np.unique(w.words[chosen[pick]], return_inverse=True)
            # none, the largest number, comes last among the picked words too; where it isn't there, nothing names it
            rows = compact.reshape(-1, WINDOW)
            x, origin = net.inputs(_picked(words, numbers))
            g = net.gradients(x, origin, rows, w.inside[chosen[pick]], target[pick], np.ones(len(pick), np.float32))
            for k in net.p:
                if k == "scale":
                    continue
                m, v = moment[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        rate *= 0.1 ** (1 / epochs)
        x, _ = net.inputs(words)
        logits = net.logits(x, w)
    drawn = np.bincount(toxic, minlength=2)
    weights = np.array(of_all if of_all and min(of_all) else drawn)[toxic] / drawn[toxic]
    _calibrate(net, np.maximum.reduceat(logits, w.firsts), toxic, weights / weights.mean())
    return net


def _picked(words: Words, numbers: np.ndarray) -> Words:
    some = Words.__new__(Words)
    real = numbers[numbers < len(words.hashes)]
    some.hashes, some.starts, some.lengths, some.data = words.hashes[real], words.starts[real], words.lengths[real], words.data
    return some


def _calibrate(net: Network, highest: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> None:
    scale, shift = 1.0, 0.0
    for _ in range(600):
        off = (_sigmoid(scale * highest + shift) - toxic) * weights
        scale -= 0.05 * ((off * highest).mean() + 0.01 * (scale - 1))
        shift -= 0.2 * off.mean()
    net.p["scale"] = np.array([max(scale, 0.05), shift], np.float32)


def known_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, toxic): one label of each document that isn't held out, without null labels and null keys."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    return known.where(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))


def fair_share(sizes: list[int], most: int) -> int:
    """The greatest share of bytes with which texts of these sizes, none taking more than it, come to most together."""
    rest, left = most, sorted(sizes)
    while left and left[0] * len(left) <= rest:
        rest -= left.pop(0)
    return rest // len(left) if left else max(sizes, default=0)


def spread(data: bytes, share: int) -> bytes:
    """data, or of one longer than share at most so many bytes: pieces of SEGMENT bytes, evenly from start to end."""
    if len(data) <= share:
        return data
    size = min(SEGMENT, share)
    pieces = max(1, share // (size + 1))
    starts = [(len(data) - size) * k // max(1, pieces - 1) for k in range(pieces)]
    return b" ".join([data[at : at + size] for at in starts])


def _spread_texts(shares: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True)
            cut_up = pa.array([spread(t, shares[label]) for t, label in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cut_up, batch.column(2), batch.column(3)], ["doc_id", "text", "toxic", "draw"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """At most rows labelled texts of either label that are not held out, in the order of a hash: a bounded sample.

    Each of them is in it, of any length. Where a label's texts have more than most_bytes together, the longest are
    represented by pieces of them, evenly spread over the whole text, all by as many bytes. Null labels and null keys are
    no labels, null texts no texts; rows that repeat a key are drawn each. Texts are bytes.
    """
    known = known_labels(labels, key).withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    # twice the rows, for those that have no text
    picked = known.where("toxic = 1").orderBy("draw").limit(2 * rows).unionByName(known.where("toxic = 0").orderBy("draw").limit(2 * rows))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    both = cut(texts.withColumn("bytes", F.octet_length("text")).join(F.broadcast(picked), "doc_id"), "labelled")  # read once
    sample, sizes = None, {}
    for label in (0, 1):
        drawn = both.where(F.col("toxic") == label).orderBy("draw", "bytes", "text").limit(rows)
        sizes[label] = [r["bytes"] for r in drawn.select("draw", "bytes").collect()]
        sample = drawn if sample is None else sample.unionByName(drawn)
    shares = {label: fair_share(of, most_bytes) for label, of in sizes.items()}
    out = sample.select("doc_id", "text", "toxic", "draw").mapInArrow(_spread_texts(shares), "doc_id long, text binary, toxic int, draw long").toPandas()
    release(both)
    return out.sort_values(["draw", "doc_id", "text"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Network:
    counts = {r["toxic"]: r["n"] for r in known_labels(labels, key).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = training_rows(docs, labels, key, text, rows)
    return train([bytes(t) for t in sample["text"]], sample["toxic"].to_numpy(), (counts.get(0, 0), counts.get(1, 0)))


def score_column(docs: DataFrame, net: Network, text: str = "text") -> F.Column:
    """The score of a text column, in batches of rows inside tasks."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.score([(t or "").encode() for t in texts]))

    return scored(F.coalesce(F.col(text).cast("string"), F.lit("")))


def score_documents(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns held_out, score and predicted added (and replaced, if there are such already).

    All overlapping windows of the whole text are scored. Null and empty texts have one empty window. Null keys and
    repeated rows are scored like any other row.
    """
    score = score_column(docs, net, text)
    out = docs.withColumns({"held_out": held_out(key), "score": score})
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that a network fitted to labels scores below one half.

    Null and empty texts are scored as one empty window, null keys and repeated rows like any other row. Without labels
    nothing is rejected, as without rows nothing is; extra columns, whatever their names, stay as they are.
    """
    return docs.where(score_column(docs, fit(docs, labels, key, text), text) < 0.5)
