"""Removal of byte strings of 100 that occur earlier in the corpus, by distributed prefix doubling.

Ranks are fingerprints, equal for equal strings. The plain form sorts a rank for every byte at every offset,
some twenty times the input; here the first offset is sampled. Each 100-byte window is represented by the
GRAM-byte string in it whose hash is least, so equal windows share it wherever they stand, and one position in
about 37 is sorted. From there on, as in prefix doubling, positions whose rank is unique drop out:

1. Sampled positions are sorted by the rank pair (rank of the GRAM bytes, rank of all bytes of the windows that
   they represent). A pair that stands earlier too removes all of its windows; a GRAM that is unique drops out.
2. What is left (equal GRAMs in different surroundings: the edges of repeats) goes to the full length: each
   window by itself, under the rank pair of its halves, rank50(i) and rank50(i + 50). Rows sorted by GRAM bring
   the bytes of their windows along, and a task ranks those of one GRAM together; GRAMs of more than CLASS
   rows are spread by rank pair instead, salted.

Within a task's batch, pairs that occur twice are settled at once, so a hot pair sends one row per batch. A hot GRAM
in many surroundings is dealt to cells by the second rank of its pairs; its first occurrences go to step 2.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, release, salt_of, slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a repeat; bytes of a representative; representatives that a window can choose from.
LENGTH, GRAM = 100, 28
CHOICE = LENGTH - GRAM + 1
#: Rows of a GRAM that are compared in one task; more are spread, window by window.
CLASS = 2048
#: Bytes of text that are worked on at a time.
WORK = 4_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)


class Ranks:
    """Fingerprints of all substrings of a buffer: differences of running sums of byte values times powers."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        values = np.random.default_rng(base & 0xFFFF).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        power, inverse = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power[:n], out=self.sums[1:])
        self.inverse = inverse

    def all(self, length: int) -> np.ndarray:
        """Of the strings of this length at every position that has one."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if base not in _KNOWN or len(_KNOWN[base][0]) < n:
        n = 1 << n.bit_length()
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps))
        _KNOWN[base] = (pair[0], pair[1])
    return _KNOWN[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def sampled(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, gram rank, rank of the windows' bytes) of each representative.

    data holds texts at begins to ends. Windows are given by their first byte, counted within their text.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    if len(data) < LENGTH:
        return none
    ranks = Ranks(data, _BASES[0])
    grams = ranks.all(GRAM)
    bits = np.uint64(int(len(data)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # the hash's high bits, then the position: the least is the leftmost of the least hashes
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= CHOICE:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < CHOICE:
        least = np.minimum(least[: len(least) - (CHOICE - span)], least[CHOICE - span :])
    chosen = (least & mask).astype(np.int64)
    sizes = np.maximum(ends - begins - LENGTH + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(begins)), sizes)
    if not len(text):
        return none
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[text]
    at = chosen[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    s0, s1, t, p = start[first], start[last], text[first], at[first]
    whole = ranks.of(s0, s1 + LENGTH) ^ mixed((p - s0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (s1 - s0).astype(np.uint64))
    return t, s0 - begins[t], s1 - begins[t], grams[p], whole


def _buffers(texts: list[bytes | None]):
    """(index of the text and offset of each piece, joined bytes, begins, ends) of runs of pieces of about WORK bytes.

    A longer text is cut into pieces that share LENGTH - 1 bytes, so that each window is in just one.
    """
    places: list[tuple[int, int]] = []
    run: list[bytes | memoryview] = []
    size = 0

    def handed():
        ends = np.cumsum([len(x) for x in run])
        return np.array(places), np.frombuffer(b"".join(run), np.uint8), np.concatenate([[0], ends[:-1]]), ends

    for i, t in enumerate(texts):
        t = memoryview(t or b"")
        for at in range(0, max(1, len(t) - LENGTH + 1), WORK):
            piece = t[at : at + WORK + LENGTH - 1]
            if run and size + len(piece) > WORK:
                yield handed()
                places, run, size = [], [], 0
            places.append((i, at))
            run.append(piece)
            size += len(piece)
    if run:
        yield handed()


#: A string that has more than a HOT-th of all marks is dealt by its surroundings; there are HOT of them at most.
HOT = 8192


def _frequent(batches):
    """(gram, rows) of the grams that have a good share of a task's open marks, and (null, all rows)."""
    counts: dict[int, int] = {}
    total = 0
    for b in _marked(batches):
        gram = b.column("gram").to_numpy()[~b.column("removed").to_numpy(zero_copy_only=False)]
        total += len(gram)
        found, n = np.unique(gram, return_counts=True)
        for g, c in zip(found[n > 2].tolist(), n[n > 2].tolist()):
            counts[g] = counts.get(g, 0) + c
        if len(counts) > 64 * HOT:  # what is rare so far goes: less than a HOT-th of the rows, and so not hot by them
            counts = {g: c for g, c in counts.items() if c * 4 * HOT > total}
    kept = [(g, c) for g, c in counts.items() if c * 4 * HOT > total]
    made = [pa.array([*(g for g, _ in kept), None], pa.int64()), pa.array([*(c for _, c in kept), total], pa.int64())]
    yield pa.RecordBatch.from_arrays(made, ["gram", "rows"])


def hot_grams(keyed: DataFrame) -> np.ndarray:
    """Sorted ranks of the grams with more than a HOT-th of all open marks of texts (id, tag, text), HOT at most.

    Which they are decides only where their rows are compared, not what is found.
    """
    counts = written(keyed.mapInArrow(_frequent, "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows")), "frequent")
    total = counts.filter("gram is null").agg(F.max("rows")).first()[0] or 0
    rows = counts.filter("gram is not null").filter(F.col("rows") * HOT > total).orderBy(F.desc("rows")).limit(HOT).collect()
    discard(counts)
    return np.sort(np.array([r["gram"] for r in rows], np.int64))


_MARKS = "gram long, whole long, id long, tag long, first int, last int, removed boolean"
#: Cells that the marks of a hot gram are dealt to, by the ranks of their windows.
CELLS = 127


def _marked(batches):
    for b in slices(batches, 2000):
        ids, tags = b.column("id").to_numpy(), b.column("tag").to_numpy()
        for places, data, begins, ends in _buffers(b.column("text").cast(pa.large_binary()).to_pylist()):
            t, s0, s1, gram, whole = sampled(data, begins, ends)
            if not len(t):
                continue
            t, off = places[t, 0], places[t, 1]
            s0, s1 = s0 + off, s1 + off
            own, tag = ids[t], tags[t]
            order = np.lexsort((s0, tag, own, whole, gram))
            t, s0, s1, gram, whole, own, tag = (x[order] for x in (t, s0, s1, gram, whole, own, tag))
            head = np.ones(len(t), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (own > own[lead]) | ((own == own[lead]) & ((tag > tag[lead]) | ((tag == tag[lead]) & (s0 > s0[lead]))))
            # settled rows: neighbours in a text become one, and go anywhere
            done = np.flatnonzero(later)[np.lexsort((s0[later], t[later]))]
            new = np.ones(len(done), bool)
            new[1:] = (t[done[1:]] != t[done[:-1]]) | (s0[done[1:]] != s1[done[:-1]] + 1)
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(done)) - 1 if len(i) else i
            spread = mixed(own[done[i]].astype(np.uint64) * np.uint64(_BASES[0]) + s0[done[i]].astype(np.uint64))
            on = np.concatenate([np.flatnonzero(~later), done[i]])
            last = np.concatenate([s1[~later], s1[done[j]]]).astype(np.int32)
            gram = np.concatenate([gram[~later], spread])
            columns = [gram.view(np.int64), whole[on].view(np.int64), own[on], tag[on], s0[on].astype(np.int32), last, later[on]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "whole", "id", "tag", "first", "last", "removed"])


def _dealt(shared):
    """Marks with the cell of their gram that they go to: 0, but for hot grams."""

    def run(batches):
        hot = shared.value
        for b in _marked(batches):
            gram, whole = b.column("gram").to_numpy(), b.column("whole").to_numpy()
            cell = np.where(np.isin(gram, hot), 1 + (whole.view(np.uint64) % np.uint64(CELLS)).astype(np.int32), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return run


def _edges(batches):
    """A row per run of windows, with the bytes that they cover."""
    names = ["gram", "large", "id", "tag", "first", "last", "covered"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for b in slices(batches):
        rows = []
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        for own, tag, text, runs in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), texts, b.column("runs").to_pylist(), strict=True):
            rows += [(r["gram"], r["large"], own, tag, r["first"], r["last"], text[r["first"] : r["last"] + LENGTH]) for r in runs]
        made = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(made, types, strict=True)], names)


def _ranked(edges: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """(rank of the first half, of the second half, id, tag, first byte) of all windows of some rows of _edges()."""
    half = LENGTH // 2
    first, last = edges.column("first").to_numpy().astype(np.int64), edges.column("last").to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(edges.column("covered").to_pylist()), np.uint8)
    sizes = last - first + 1
    begins = np.cumsum(sizes + LENGTH - 1) - sizes - LENGTH + 1
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = step + np.repeat(begins, sizes)
    a, c = (Ranks(data, base) for base in _BASES)
    own, tag = (np.repeat(edges.column(n).to_numpy(), sizes) for n in ("id", "tag"))
    return a.of(at, at + half), c.of(at + half, at + LENGTH), own, tag, step + np.repeat(first, sizes)


def _later(left, right, own, tag, first) -> tuple[np.ndarray, np.ndarray]:
    """(an order by rank pair and place, whether each of that order stands after the first of its rank pair)."""
    order = np.lexsort((first, tag, own, right, left))
    left, right, own, tag, first = (x[order] for x in (left, right, own, tag, first))
    head = np.ones(len(left), bool)
    head[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, int)
    return order, (own > own[lead]) | ((own == own[lead]) & ((tag > tag[lead]) | ((tag == tag[lead]) & (first > first[lead]))))


def _runs(at: np.ndarray, own, tag, first) -> tuple[np.ndarray, ...]:
    """(id, tag, first byte of the first window, of the last) of the runs that windows `at` make in their rows."""
    at = np.sort(at)
    own, tag, first = own[at], tag[at], first[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] != first[:-1] + 1)
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(at)) - 1 if len(i) else i
    return own[i], tag[i], first[i].astype(np.int32), first[j].astype(np.int32)


def _settled_classes(batches):
    """Runs of windows that stand earlier too, of rows of _edges() sorted by gram; a gram's rows are compared at once."""

    def settled(edges: pa.Table):
        left, right, own, tag, first = _ranked(edges)
        order, later = _later(left, right, own, tag, first)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(order[later], own, tag, first)], ["id", "tag", "first", "last"])

    pending: list[pa.RecordBatch] = []
    for b in batches:
        pending.append(b)
        if sum(x.num_rows for x in pending) >= CLASS:
            t = pa.Table.from_batches(pending).combine_chunks()
            keys = t.column("gram").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield settled(t.slice(0, cut))
                pending = t.slice(cut).to_batches()
    if pending:
        yield settled(pa.Table.from_batches(pending).combine_chunks())


def _windows(batches):
    """A row per window of rows of _edges(), but of equal ones of a batch the first only; the others as runs."""
    names = ["left", "right", "id", "tag", "first", "last", "removed"]
    for b in batches:
        left, right, own, tag, first = _ranked(b)
        order, later = _later(left, right, own, tag, first)
        on = order[~later]
        open_ = [left[on].view(np.int64), right[on].view(np.int64), own[on], tag[on], first[on].astype(np.int32), first[on].astype(np.int32), np.zeros(len(on), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in open_], names)
        runs = _runs(order[later], own, tag, first)
        none = np.zeros(len(runs[0]), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (none, none, *runs, np.ones(len(none), bool))], names)


def spans_of(length: int, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs (begin, end) of bytes that the pieces cover."""
    out: list[list[int]] = []
    for begin, end in sorted(pieces):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, min(b, length)) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for begin, end in spans:
        parts.append(text[at:begin])
        at = end
    return b"".join([*parts, text[at:]])


def _cut(batches):
    for b in slices(batches):
        rows = []
        for text, pieces in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("pieces").to_pylist(), strict=True):
            text = text or b""
            spans = spans_of(len(text), [(p["first"], p["last"] + LENGTH) for p in pieces or []])
            kept = kept_bytes(text, spans)
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"begin": x, "end": y} for x, y in spans]))
        made = list(zip(*rows, strict=True)) if rows else [[]] * 5
        spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(m, pa.int64()) for m in made[:3]), pa.array(made[3], pa.string()), pa.array(made[4], spans_type)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def all_but_first(open_: DataFrame) -> DataFrame:
    """place, row of all rows of (ranks, place, row) but the first place of each rank pair (which may repeat).

    A rank pair's rows are dealt to salted cells. Whatever is not the first of its cell is none of its pair either;
    the firsts of the cells, as many as there are salts at most, then meet by pair. Nothing is joined.
    """
    least = lambda *keys: F.min("place").over(Window.partitionBy(*keys))
    cells = open_.withColumn("_salt", salt_of(F.col("row")))
    cells = cells.withColumn("lead", least("ranks", "_salt"))
    firsts = cells.filter(F.col("place") == F.col("lead")).select("ranks", "place", "row").withColumn("lead", least("ranks"))
    later = cells.select("place", "row", "lead").unionByName(firsts.select("place", "row", "lead"))
    return later.filter(F.col("place") > F.col("lead")).drop("lead")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of begin, end) for each row of (doc_id, text).

    A byte is removed if a LENGTH-byte string that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. A null text counts as empty, a null id as the smallest. Rows that repeat an
    id are documents of their own, in the order of their texts' hashes; rows that repeat id and text are one
    document, reported as often. Long texts are cut only for ranking, with an overlap; other columns, whatever
    their names, are ignored.
    """
    docs = docs.select("doc_id", "text")
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tag = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), tag.alias("tag"), "text")
    key = ["id", "tag"]
    long = keyed.select("id", "tag", "text").filter(F.octet_length("text") >= LENGTH)
    shared = docs.sparkSession.sparkContext.broadcast(hot_grams(long))  # HOT numbers at most
    rows = long.mapInArrow(_dealt(shared), f"{_MARKS}, cell int")
    place = F.struct("id", "tag", "first")
    by_gram = Window.partitionBy("gram", "cell").orderBy("whole", "id", "tag", "first")
    whole_gram = Window.partitionBy("gram", "cell")
    near = lambda f, c: f(c).over(by_gram)
    # the first of a run of equal pairs stands where the pair begins; what it says is carried along the run
    begins = ~F.coalesce(near(F.lag, "whole") == F.col("whole"), F.lit(False))
    rows = rows.withColumn("lead", F.when(begins, place)).withColumn("lead", F.last("lead", True).over(by_gram))
    rows = rows.withColumn("before", near(F.lag, "whole")).withColumn("after", near(F.lead, "whole"))
    later = F.col("removed") | (place > F.col("lead"))
    # of the leaders, those whose gram has another pair: some neighbour of their run differs, or may in another cell
    alone = F.col("before").isNull() & (F.col("top") == F.col("whole")) & (F.col("cell") == 0)
    rows = rows.withColumn("top", F.max("whole").over(whole_gram)).withColumn("n", F.count(F.lit(1)).over(whole_gram))
    gram = F.when(~later, F.col("gram"))
    marks = rows.select(gram.alias("gram"), "id", "tag", "first", "last", later.alias("removed"), (~alone).alias("edge"), ((F.col("n") > CLASS) | (F.col("cell") > 0)).alias("large")).filter("removed or edge")
    marks = written(marks.drop("edge"), "marks")
    release(docs)
    runs = marks.filter("not removed").groupBy(*key).agg(F.collect_list(F.struct("first", "last", "gram", "large")).alias("runs"))
    texts = keyed.select("id", "tag", "text").dropDuplicates(key) if repeated else keyed.select("id", "tag", "text")
    edges = texts.join(runs, key).mapInArrow(_edges, "gram long, large boolean, id long, tag long, first int, last int, covered binary")
    edges = written(edges, "edges")
    release(docs)
    small = edges.filter("not large").repartition("gram").sortWithinPartitions("gram").mapInArrow(_settled_classes, "id long, tag long, first int, last int")
    small = written(small, "small")
    windows = edges.filter("large").mapInArrow(_windows, "left long, right long, id long, tag long, first int, last int, removed boolean")
    windows = written(windows, "windows")
    discard(edges)
    release(docs)
    open_ = windows.filter("not removed").select(F.struct("left", "right").alias("ranks"), place.alias("place"), F.xxhash64("id", "tag", "first").alias("row"))
    spread = all_but_first(open_).select("place.*")
    spread = spread.withColumn("last", F.col("first")).unionByName(windows.filter("removed").select("id", "tag", "first", "last"))
    spread = written(spread, "spread")
    discard(windows)
    settled = small.unionByName(spread)
    release(docs)
    pieces = marks.filter("removed").select("id", "tag", "first", "last").unionByName(settled)
    pieces = pieces.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("pieces"))
    return _reported(keyed.join(pieces, key, "left"))


def _reported(rows: DataFrame) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"
    return rows.select("doc_id", "text", "pieces").mapInArrow(_cut, schema)


def _positions(batches):
    """A row for each position that begins a string of a quarter of LENGTH, with its rank."""
    quarter = LENGTH // 4
    for b in slices(batches, 100):
        for places, data, begins, ends in _buffers(b.column("text").cast(pa.large_binary()).to_pylist()):
            if len(data) < quarter:
                continue
            ranks = Ranks(data, _BASES[0]).all(quarter)
            for (i, off), begin, end in zip(places.tolist(), begins.tolist(), ends.tolist()):
                n = min(end - begin - quarter + 1, WORK)  # the next piece has the rest
                if n > 0:
                    own = pa.array(np.full(n, b.column("id")[i].as_py()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(off, off + n)), pa.array(ranks[begin : begin + n].view(np.int64))], ["id", "at", "rank"])


def doubled_spans(docs: DataFrame) -> DataFrame:
    """What repeated_spans() returns, by plain prefix doubling over every position; for docs whose doc_ids differ.

    Positions are ranked by 25 bytes, then by 50 and 100: each round joins a position's rank with that of the position
    one offset on, groups equal rank pairs, names a group by its first position, which is its new rank, and drops
    positions whose pair is unique. repeated_spans() does the same with fewer rows; this measures what they save.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    place = F.struct("id", "at")
    now = keyed.filter(F.octet_length("text") >= LENGTH).select("id", "text").mapInArrow(_positions, "id long, at long, rank long")
    now = written(now.select("id", "at", F.struct(F.col("rank").alias("id"), F.lit(0).cast("long").alias("at")).alias("rank")), "rank25")
    for offset in (LENGTH // 4, LENGTH // 2):
        on = now.select("id", (F.col("at") - offset).alias("at"), F.col("rank").alias("next"))
        pairs = now.join(on, ["id", "at"]).select("id", "at", F.struct("rank", "next").alias("pair"))
        groups = pairs.groupBy("pair").agg(F.min(place).alias("rank"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        after = written(pairs.join(groups, "pair").select("id", "at", "rank"), f"rank{2 * offset}")
        discard(now)
        now = after
    again = now.filter(place > F.col("rank")).select("id", F.struct(F.col("at").cast("int").alias("first"), F.col("at").cast("int").alias("last")).alias("w"))
    pieces = again.groupBy("id").agg(F.collect_list("w").alias("pieces"))
    return _reported(keyed.join(pieces, "id", "left"))
