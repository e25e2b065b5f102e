"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word shingles form one class, whose first document represents it. MinHash bands
name candidate pairs of representatives; pairs are compared a few hash values at a time, and dropped when the
posterior probability of a similarity of at least the threshold falls below a tolerance. What survives is
verified on the sets themselves (of 64-bit ranks of shingles). Large buckets are cut into blocks, and pairs of blocks are compared in cells
of bounded size; a pair is looked at further only in the first band that it shares. No pair becomes a row: a
cell returns one row for each of its documents. A bucket of n documents with n different sets costs n * n / 2
comparisons of signatures, whose rows are copied n / BLOCK times; exact copies cost nothing, as one stands for all.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 1e-7; pruning loses fewer than
TOLERANCE of such pairs at each of its steps.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, fresh, one_row_each, release, slices, with_group, written
from graphloom.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Hash values compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Documents of a block, and their shingles (8 bytes each), about; a cell holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Pairs of a cell whose signatures are compared at a time, and shingles of partners that are looked up at a time.
PAIRS, SHINGLES = 16384, 500_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit ranks of a text's word n-grams; fewer words make one shingle, no words none."""
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _factors() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    out = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), 2048):
        part = factors[:, None] * found[None, i : i + 2048]
        np.minimum(out, (part >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared: the fewest matches with which a pair is still looked at.

    With a uniform prior, P(similarity >= t | m of n match) is P(Bin(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _sketched(batches):
    import xxhash

    factors = _factors()
    for b in slices(batches):
        sets = [shingles(t) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        known: dict[bytes, bytes] = {}
        for d, s in zip(digests, sets, strict=True):
            if d is not None and d not in known:
                known[d] = signature(s, factors).tobytes()
        made = [pa.array(digests, pa.binary()), pa.array([known.get(d) for d in digests], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "tag")), *made], ["doc_id", "tag", "digest", "sig", "n_shingles"])


def _banded(batches):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(sig.shape[:2], np.uint64)
        for i in range(ROWS):
            key = (key ^ sig[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        values = pa.array(key.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), values)
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("n_shingles"), lists], ["uid", "n_shingles", "bands"])


def _groups(batches, key: str):
    """Tables of the rows of each key, of batches sorted by key."""
    pending: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if pending and pending[-1].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(pending)
            pending = []
        for i, j in zip(cuts, cuts[1:]):
            pending.append(t.slice(i, j - i))
            if j < len(keys):
                yield pa.concat_tables(pending)
                pending = []
    if pending:
        yield pa.concat_tables(pending)


def _pairs(block: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cell: within its one block, or across its two."""
    if diagonal:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _alike(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of some pairs of rows that no look at the posterior drops, and that share no band before this one."""
    matches = np.zeros(len(i), np.int64)
    for n in range(0, HASHES, STEP):
        matches += (sig[i, n : n + STEP] == sig[j, n : n + STEP]).sum(axis=1)
        on = matches >= least[n + STEP]
        i, j, matches = i[on], j[on], matches[on]
    if not len(i):
        return i, j
    shared = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(axis=2)
    on = shared.argmax(axis=1) == band
    return i[on], j[on]


def _survivors(batches):
    least = fewest_matches()
    for cell in _groups(batches, "cell"):
        if cell.num_rows < 2:
            continue
        uid = cell.column("uid").to_numpy()
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(len(uid), HASHES)
        i, j = _pairs(cell.column("block").to_numpy(), cell.column("diagonal")[0].as_py())
        band = cell.column("band")[0].as_py()
        found = [_alike(sig, i[n : n + PAIRS], j[n : n + PAIRS], band, least) for n in range(0, len(i), PAIRS)]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (i, j)
        if not len(i):
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        rows = np.unique(np.concatenate([i, j]))
        begin, end = np.searchsorted(i, rows, "left"), np.searchsorted(i, rows, "right")
        partners = pa.array([uid[j[x:y]] for x, y in zip(begin, end)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell.column("cell")[0].as_py())), pa.array(uid[rows]), partners], ["cell", "uid", "partners"])


def _shingled(batches):
    for b in slices(batches):
        sets = [shingles(t).tobytes() for t in b.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("size"), pa.array(sets, pa.binary())], ["uid", "size", "found"])


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some sets has in common with one."""
    sizes = np.array([len(x) for x in others])
    everything = np.concatenate(others)
    where = np.minimum(np.searchsorted(one, everything), len(one) - 1)
    return np.add.reduceat(one[where] == everything, np.cumsum(sizes) - sizes, dtype=np.int64)


def _verified(batches):
    for cell in _groups(batches, "cell"):
        uid, size = cell.column("uid").to_numpy(), cell.column("size").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("found").to_pylist()]
        place = {int(u): i for i, u in enumerate(uid)}
        links = np.zeros(len(uid), np.int64)
        root = list(range(len(uid)))

        def top(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, partners in enumerate(cell.column("partners").to_pylist()):
            if not partners:
                continue
            at = np.array([place[p] for p in partners])
            sizes = np.array([len(sets[j]) for j in at])
            runs = np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes) // SHINGLES)) + 1)
            inside = np.concatenate([_common(sets[i], [sets[j] for j in run]) for run in runs])
            # >= THRESHOLD in whole numbers, free of rounding
            for j in at[inside * 10 >= round(THRESHOLD * 10) * (len(sets[i]) + sizes - inside)]:
                links[i] += size[j]
                links[j] += size[i]
                a, b = top(i), top(int(j))
                if uid[a] > uid[b]:
                    a, b = b, a
                root[b] = a
        on = np.flatnonzero(links)
        label = np.array([uid[top(int(i))] for i in on], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uid[on]), pa.array(label, pa.int64()), pa.array(links[on])], ["uid", "label", "links"])


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, tag, class_id, class_size, n_links, first of each row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of 5-word shingles (A-Z lower-cased) is at
    least 0.8; classes are the connected components, named by their least doc_id. n_links counts all linked
    documents, copies too. Texts of fewer words are one shingle; texts without words, and nulls, are linked
    with nothing. first marks one row of each class, of the least doc_id. Rows that repeat an id are documents
    of their own. tag is a hash of the text, to find the row again. Long texts are shingled whole; other columns,
    whatever their names, are ignored.
    """
    keyed = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, digest binary, sig binary, n_shingles long"
    sketches = written(keyed.mapInArrow(_sketched, schema).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    worded = with_group(sketches.filter("digest is not null").select("uid", "doc_id", "tag", "digest"), "digest", "uid", {"rep": ("min", "uid"), "size": ("count", "uid")})
    members = written(worded.select("uid", "doc_id", "tag", "rep", "size"), "members")
    heads = members.filter("uid = rep").select("uid", "size")
    sets = written(sketches.select("uid", "sig", "n_shingles").join(heads, "uid"), "sets")
    bands = sets.mapInArrow(_banded, "uid long, n_shingles long, bands array<long>").select("uid", "n_shingles", F.posexplode("bands").alias("band", "key"))
    bands = written(bands, "bands")
    full = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all")).filter("n > 1")
    placed = bands.drop("n_shingles").join(full, ["band", "key"])
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least("n", F.col("all") / BLOCK_SHINGLES))).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("band", "key", F.least("block", "other"), F.greatest("block", "other"))
    cells = cells.select(cell.alias("cell"), "band", "block", (F.col("block") == F.col("other")).alias("diagonal"), "uid")
    cells = cells.join(sets.select("uid", "sig"), "uid").repartition("cell").sortWithinPartitions("cell")
    pairs = written(cells.mapInArrow(_survivors, "cell long, uid long, partners array<long>"), "pairs")
    discard(bands)
    release(docs)
    asked = pairs.select("uid").distinct().join(members.select("uid", "doc_id", "tag", "size"), "uid")
    texts = keyed.dropDuplicates(["doc_id", "tag"]) if _repeats(keyed) else keyed
    same = texts["tag"].eqNullSafe(asked["tag"]) & texts["doc_id"].eqNullSafe(asked["doc_id"])
    found = texts.join(asked, same).select("uid", "size", "text").mapInArrow(_shingled, "uid long, size long, found binary")
    found = written(found, "shingles")
    release(docs)
    held = pairs.join(found, "uid").select("cell", "uid", "size", "found", "partners").repartition("cell").sortWithinPartitions("cell")
    linked = written(held.mapInArrow(_verified, "uid long, label long, links long"), "links")
    discard(found)
    release(docs)
    labels = components(linked.select(F.col("uid").alias("u"), F.col("label").alias("v")))
    counts = linked.groupBy("uid").agg(F.sum("links").alias("links"))
    named = counts.join(labels.withColumnRenamed("u", "uid"), "uid", "left")
    known = written(named.select(F.col("uid").alias("rep"), "links", F.coalesce("label", "uid").alias("label")), "labels")
    rows = members.join(known, "rep", "left").select("uid", "doc_id", "tag", F.coalesce("label", "rep").alias("label"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lone = sketches.filter("digest is null").select("uid", "doc_id", "tag", F.col("uid").alias("label"), F.lit(0).cast("long").alias("n_links"))
    rows = written(rows.unionByName(lone).withColumn("at", F.struct("doc_id", "uid")), "rows")
    rows = with_group(rows, "label", "uid", {"low": ("min", "at"), "class_size": ("count", "uid")})
    return rows.select("doc_id", "tag", F.col("low.doc_id").alias("class_id"), "class_size", "n_links", (F.col("uid") == F.col("low.uid")).alias("first"))


def _repeats(keyed: DataFrame) -> bool:
    return not keyed.groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class of similar documents, that of the least doc_id; with all of docs' columns.

    Columns may have any names. Rows that repeat a doc_id with one text are alike: of those the one that is least
    as JSON stands for all. Rows whose text has no words, or is null, all stay, but for such repeats.
    """
    kept_id, kept_tag = fresh(docs, "_id", "_tag")
    tag = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    kept = similar_classes(docs).filter("first").select(F.col("doc_id").alias(kept_id), F.col("tag").alias(kept_tag))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept_id]) & tag.eqNullSafe(kept[kept_tag]), "left_semi")
    return one_row_each(rows, [rows["doc_id"], F.xxhash64(rows["text"])]) if _repeats(docs) else rows
