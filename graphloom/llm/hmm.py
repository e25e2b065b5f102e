"""A hidden Markov language model, trained by Baum-Welch over the whole training corpus.

Symbols: the HEAD most frequent training words, each by itself; all other words by TAIL hash buckets, within
which a word has its smoothed share of the bucket's training tokens; and the end of a text. Head, buckets and
states are bounded, so a model is a few megabytes whatever the corpus; exact counts of all other words stay
in a table, which is joined with the rare words of each document. Rare words cannot be hot keys: none is
more frequent than any head word.

A text's probability is the sum over all state paths, computed by the scaled forward recursion. Texts are cut
into segments whose transfer matrices are computed side by side and chained, so one long text costs no more
per word than many short ones, and memory is bounded by the segments at work.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES, HEAD, TAIL = 8, 32768, 32768
END = HEAD + TAIL
SYMBOLS = END + 1
ITERATIONS = 4
#: Pseudo-count of an unseen word, and the tokens that a state borrows from the corpus distribution.
DELTA, BORROWED = 0.1, 500.0
#: Tokens of a segment, segments worked on at a time, and steps between rescalings of transfer matrices.
SEGMENT, TOGETHER, RESCALE = 256, 512, 16
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000


@dataclass
class Model:
    start: np.ndarray  # K: the silent state before the first token
    move: np.ndarray  # K x K
    emit: np.ndarray  # SYMBOLS x K

    @classmethod
    def first(cls, frequency: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        """Sticky states whose emissions are the corpus distribution, each perturbed in its own way."""
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * np.exp(rng.normal(0.0, 1.0, (len(frequency), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Segments:
    """Texts (lists of symbols, each ending with END) cut into segments of at most SEGMENT symbols."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        counts = -(-lengths // SEGMENT)
        self.texts = len(lengths)
        self.text = np.repeat(np.arange(self.texts), counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        self.place = np.arange(first[-1]) - first[self.text]
        self.begin = offsets[self.text] + self.place * SEGMENT
        self.length = np.minimum(SEGMENT, offsets[self.text + 1] - self.begin)
        self.symbols = symbols
        self.by_place = np.argsort(self.place, kind="stable")
        self.place_ends = np.cumsum(np.bincount(self.place)) if len(self.place) else np.zeros(0, int)

    def groups(self, which: np.ndarray | None = None):
        """Segments (all, or those named) to work on together, longest first; with how many reach each step."""
        order = np.argsort(-self.length, kind="stable") if which is None else which[np.argsort(-self.length[which], kind="stable")]
        for i in range(0, len(order), TOGETHER):
            at = order[i : i + TOGETHER]
            reach = np.searchsorted(-self.length[at], -np.arange(self.length[at[0]]), side="left")
            yield at, reach

    def taken(self, at: np.ndarray, steps: int) -> np.ndarray:
        """steps x segments: their symbols; past a segment's end any symbol."""
        where = self.begin[at][None, :] + np.arange(steps)[:, None]
        return self.symbols[np.minimum(where, len(self.symbols) - 1)]

    def transfer(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(matrices scaled to a largest entry of 1, natural logs of their scales) of all segments.

        A first segment is entered in the start state only, so it needs that one row, which stands in all of
        its matrix's rows.
        """
        k = len(model.start)
        out, logs = np.empty((len(self.text), k, k)), np.zeros(len(self.text))
        for at, reach in self.groups(np.flatnonzero(self.place == 0)):
            b = model.emit[self.taken(at, len(reach))]
            state = np.broadcast_to(model.start, (len(at), k)).copy()
            scale = np.zeros(len(at))
            for t, n in enumerate(reach):
                state[:n] = (state[:n] @ model.move) * b[t, :n]
                if t % RESCALE == RESCALE - 1 or t == len(reach) - 1:
                    top = state.max(axis=1)
                    state /= top[:, None]
                    scale += np.log(top)
            out[at], logs[at] = state[:, None, :], scale
        for at, reach in self.groups(np.flatnonzero(self.place > 0)):
            b = model.emit[self.taken(at, len(reach))]
            m = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
            moved = np.empty((len(at) * k, k))
            scale = np.zeros(len(at))
            for t, n in enumerate(reach):
                np.matmul(m[:n].reshape(-1, k), model.move, out=moved[: n * k])
                np.multiply(moved[: n * k].reshape(n, k, k), b[t, :n, None, :], out=m[:n])
                if t % RESCALE == RESCALE - 1 or t == len(reach) - 1:
                    top = m.max(axis=(1, 2))
                    m /= top[:, None, None]
                    scale += np.log(top)
            out[at], logs[at] = m, scale
        return out, logs

    def chained(self, model: Model, transfer: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state distribution on entering each segment, natural log probability of each text)."""
        entering = np.empty((len(self.text), len(model.start)))
        state = np.broadcast_to(model.start, (self.texts, len(model.start))).copy()
        score, begin = np.zeros(self.texts), 0
        for end in self.place_ends:
            at = self.by_place[begin:end]
            who = self.text[at]
            entering[at] = state[who]
            new = np.einsum("si,sij->sj", state[who], transfer[at])
            total = new.sum(axis=1)
            state[who] = new / total[:, None]
            score[who] += np.log(total) + logs[at]
            begin = end
        return entering, score

    def scores(self, model: Model) -> np.ndarray:
        return self.chained(model, *self.transfer(model))[1]

    def counts(self, model: Model, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
        """Adds expected counts given the model; returns the natural log probability of all texts."""
        k = len(model.start)
        transfer, logs = self.transfer(model)
        entering, score = self.chained(model, transfer, logs)
        leaving = np.empty_like(entering)
        back = np.ones((self.texts, k))
        for j in range(len(self.place_ends) - 1, -1, -1):
            at = self.by_place[self.place_ends[j - 1] if j else 0 : self.place_ends[j]]
            who = self.text[at]
            leaving[at] = back[who]
            if not j:
                break
            new = np.einsum("sij,sj->si", transfer[at], back[who])
            back[who] = new / new.sum(axis=1)[:, None]
        for at, reach in self.groups():
            steps = len(reach)
            symbols = self.taken(at, steps)
            b = model.emit[symbols]
            alpha = np.zeros((steps + 1, len(at), k))
            scale = np.ones((steps, len(at)))
            alpha[0] = entering[at]
            x, ones = np.empty((len(at), k)), np.ones(k)
            for t, n in enumerate(reach):
                np.matmul(alpha[t, :n], model.move, out=x[:n])
                x[:n] *= b[t, :n]
                np.dot(x[:n], ones, out=scale[t, :n])
                np.divide(x[:n], scale[t, :n, None], out=alpha[t + 1, :n])
            last = alpha[self.length[at], np.arange(len(at))]
            beta = leaving[at] / (last * leaving[at]).sum(axis=1)[:, None]
            weight = np.zeros((steps, len(at), k))  # emission times what follows, by scale
            gamma = np.zeros((steps, len(at), k))
            turned = np.ascontiguousarray(model.move.T)
            b /= scale[:, :, None]
            for t in range(steps - 1, -1, -1):
                n = reach[t]
                np.multiply(alpha[t + 1, :n], beta[:n], out=gamma[t, :n])
                np.multiply(b[t, :n], beta[:n], out=weight[t, :n])
                np.matmul(weight[t, :n], turned, out=beta[:n])
            head = self.place[at] == 0
            started += (model.start * beta[head]).sum(axis=0)
            moved += model.move * (alpha[:-1].reshape(-1, k).T @ weight.reshape(-1, k))
            flat = symbols.ravel()
            for i in range(k):
                emitted[:, i] += np.bincount(flat, gamma[:, :, i].ravel(), SYMBOLS)
        return float(score.sum())


def remainder10(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


def _counted(batches):
    counts: Counter = Counter()
    texts = 0

    def handed():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()

    for b in slices(batches):
        for t in b.column("text").cast(pa.large_binary()).to_pylist():
            counts.update((t or b"").lower().split())
            texts += 1
            if len(counts) > COUNTED:
                yield from handed()
    yield from handed()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts], pa.int64())], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of a column `text`, words lower-cased (A-Z); the row with a null word counts the texts."""
    return texts.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encoded_texts(texts: list[bytes | None], head: dict[bytes, int]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(symbols, rare words, how often each occurs) of each text, as lists."""
    lists = [(t or b"").lower().split() for t in texts]
    lengths = np.array([len(x) for x in lists])
    words = list(chain.from_iterable(lists))
    ids = np.fromiter(map(head.get, words, repeat(-1)), np.int32, len(words))
    at = np.flatnonzero(ids < 0)
    rare = [words[i] for i in at.tolist()]
    ids[at] = HEAD + np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % TAIL
    ends = np.cumsum(lengths)
    symbols = np.insert(ids, ends, END)  # an end after each text's words
    offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
    cuts = np.searchsorted(at, np.concatenate([[0], ends])).tolist()
    counters = [Counter(rare[i:j]) for i, j in zip(cuts, cuts[1:])]
    spans = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counters])]).astype(np.int32))
    found = pa.array(list(chain.from_iterable(counters)), pa.binary()).cast(pa.string())
    times = pa.array(list(chain.from_iterable(c.values() for c in counters)), pa.int32())
    lists_of = pa.ListArray.from_arrays
    return lists_of(pa.array(offsets), pa.array(symbols.astype(np.int32))), lists_of(spans, found), lists_of(spans, times)


def _encoded(shared):
    def run(batches):
        head = shared.value
        for b in slices(batches):
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            kept = [b.column(c) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, *encoded_texts(texts, head)], ["doc_id", "held_out", "ids", "rare", "times"])

    return run


def _pieces(batch: pa.RecordBatch, most: int = 1_000_000):
    """(first row, symbols, offsets) of runs of rows with about `most` symbols at most, longer texts alone."""
    column = batch.column("ids")
    offsets = column.offsets.to_numpy().astype(np.int64)
    symbols = column.values.to_numpy()
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, symbols[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _expected(shared):
    def run(batches):
        model = shared.value
        k = len(model.start)
        emitted, moved, started, score = np.zeros((SYMBOLS, k)), np.zeros((k, k)), np.zeros(k), 0.0
        for b in batches:
            for _, symbols, offsets in _pieces(b):
                score += Segments(symbols, offsets).counts(model, emitted, moved, started)
        rows = np.flatnonzero(emitted.any(axis=1))
        key = np.concatenate([rows, -1 - np.arange(k), [-1 - k, -2 - k]])
        values = np.concatenate([emitted[rows], moved, started[None], np.full((1, k), score / k)])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *(pa.array(values[:, i]) for i in range(k))], ["symbol", *(f"s{i}" for i in range(k))])

    return run


def train(encoded: DataFrame, frequency: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows (ids): each pass adds up expected counts over partitions, a row per symbol.

    frequency: of each symbol in the corpus, above 0. Returns the model and log10 probability before each pass.
    """
    spark = encoded.sparkSession
    model, scores = Model.first(frequency, states), []
    columns = [f"s{i}" for i in range(states)]
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)  # SYMBOLS * STATES numbers
        # a row per symbol and task, summed before and after they are dealt out by symbol
        found = encoded.select("ids").mapInArrow(_expected(shared), ", ".join(["symbol int", *(f"{c} double" for c in columns)]))
        sums = found.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        shared.unpersist()
        values, key = sums[columns].to_numpy(), sums["symbol"].to_numpy()
        if not len(key):
            break
        emitted = np.zeros((SYMBOLS, states))
        emitted[key[key >= 0]] = values[key >= 0]
        place = {int(s): i for i, s in enumerate(key)}
        moved = np.stack([values[place[-1 - i]] for i in range(states)]) + 0.1
        started = values[place[-1 - states]] + 0.1
        scores.append(float(values[place[-2 - states]].sum() / np.log(10)))
        emit = emitted + BORROWED * frequency[:, None]
        model = Model(started / started.sum(), moved / moved.sum(axis=1)[:, None], emit / emit.sum(axis=0))
    return model, scores


def _scored(shared):
    def run(batches):
        model, log_c, log_bucket, known = shared.value
        for b in batches:
            sums = np.empty((4, b.num_rows))
            for row, symbols, offsets in _pieces(b):
                s = Segments(symbols, offsets)
                end = row + s.texts
                sums[0, row:end] = s.scores(model) / np.log(10) - np.add.reduceat(log_bucket[symbols], offsets[:-1])
                sums[1, row:end] = np.add.reduceat(log_c[symbols], offsets[:-1])
                sums[2, row:end] = np.add.reduceat(known[symbols], offsets[:-1])
                sums[3, row:end] = np.diff(offsets)
            kept = [b.column(c) for c in ("row", "doc_id", "held_out")]
            made = [pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), pa.array(sums[3].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*kept, *made], ["row", "doc_id", "held_out", "score", "base", "n_known", "n_tokens"])

    return run


#: Cells that equally frequent words are dealt to by hash, to cut the head among them.
_TIES = 4096


def head_words(counts: DataFrame, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(the most frequent words, the others): `most` words at most, and all but a _TIES-th of a class of equals as many.

    The limit is found in three histograms: eighths of a doubling of the count, counts within the eighth in which it
    falls, and hashes of words within that count. Words of one count are taken by their hashes.
    """
    step, tie = F.floor(F.log2("c") * 8), F.pmod(F.xxhash64("word"), F.lit(_TIES))
    inside, head, room = F.lit(True), F.lit(False), most
    for key, order in ((step, "desc"), (F.col("c"), "desc"), (tie, "asc")):
        classes = counts.filter(inside).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        # few rows: some 500 eighths, the counts within one of them, _TIES hashes
        last, cut = None, None
        for r in sorted(classes.collect(), key=lambda r: -r["key"] if order == "desc" else r["key"]):
            if r["n"] > room:
                cut = r["key"]
                break
            room, last = room - r["n"], r["key"]
        if last is not None:
            head = head | (inside & (key >= F.lit(last) if order == "desc" else key <= F.lit(last)))
        if cut is None:
            break
        inside = inside & (key == F.lit(cut))
    return counts.filter(head), counts.filter(~head)


def score_documents(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of each row of docs.

    Rows whose crc32 of the id, as text, mod 10 is 0 are held out; a null id is not. A null text counts as
    empty, and has its end as its one token. Repeated rows are scored each, and count each in training. Ids of any
    type are taken as text; long texts are scored whole; other columns, whatever their names, are ignored.
    Without training rows nothing is known, and each word is drawn from the smoothed empty counts.
    """
    spark = docs.sparkSession
    held = F.coalesce(remainder10(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    everything = written(word_counts(rows.filter(~F.col("held_out"))), "counts")
    texts = everything.filter("word is null").agg(F.sum("c")).first()[0] or 0
    counts = everything.filter("word is not null")
    bucket = F.lit(HEAD) + F.crc32(F.col("word").cast("binary")) % TAIL
    most, tail = head_words(counts)
    top = most.select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])  # HEAD rows at most
    head = {w.encode(): i for i, w in enumerate(top["word"])}
    buckets = tail.groupBy(bucket.cast("int").alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # TAIL rows at most
    n = int(top["c"].sum() + buckets["n"].sum()) + texts
    v = len(top) + int(buckets["v"].sum()) + (texts > 0)
    in_symbol, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    in_symbol[: len(top)] = top["c"]
    in_symbol[buckets["b"]], kinds[buckets["b"]], in_symbol[END] = buckets["n"], buckets["v"], texts
    frequency = (in_symbol + DELTA) / (in_symbol + DELTA).sum()
    shared = spark.sparkContext.broadcast(head)
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(_encoded(shared), f"doc_id {kind}, held_out boolean, ids array<int>, rare array<string>, times array<int>")
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()), "symbols")
    model, _ = train(encoded.filter(~F.col("held_out")), frequency, states, iterations)
    # log10 of what each symbol gives to the base score, and of the words of a bucket's size
    single = np.ones(SYMBOLS, bool)
    single[HEAD:END] = False
    log_c = np.where(single, np.log10(in_symbol + DELTA), 0.0)
    log_bucket = np.where(single, 0.0, np.log10(in_symbol + DELTA * (kinds + 1)))
    known = (single & (in_symbol > 0)).astype(float)
    shared = spark.sparkContext.broadcast((model, log_c, log_bucket, known))
    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(_scored(shared), f"row long, doc_id {kind}, held_out boolean, score double, base double, n_known long, n_tokens long")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    looked = rare.join(tail, "word", "left")  # each word once, and in any document once
    share = F.log10(F.coalesce("c", F.lit(0)) + DELTA) * F.col("times")
    sums = looked.groupBy("row").agg(F.sum(share).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rare"))
    out = scored.join(sums, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    whole = float(np.log10(n + DELTA * (v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + log_rare - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + log_rare).alias("score"))
