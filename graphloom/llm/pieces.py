"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model runs across the start of a whitespace mark, a text's segmentation is that of its
chunks, each a run of marks and the characters up to the next mark. Every task keeps a table of the distinct
chunks that it has seen: each is segmented and decoded once by the library, and ids are joined back by
position. The table is emptied when it is full, so a task's memory is bounded. Models for which this does
not hold are run on whole texts.

encoded_by_table() has one table for all tasks instead, where each distinct chunk is segmented once in all. It
gives the same rows, and shuffles what the other keeps in memory.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
#: Chunks that a task's table holds at most, and the characters of the longest chunk that it keeps.
TABLE, LONGEST = 400_000, 64
#: Characters of a block: texts whose chunks are listed and looked up together. A longer text is a block of its own.
BLOCK = 4 << 20

#: Texts on which chunks and whole texts must agree before chunks are used.
_PROBES = ["", " ", "a", " a", "a ", "a  b", f"{MARK}a{MARK}", "x\ny", "ﬁ ① é", "\t a", "a　b", "<s> </s><unk>", "\U0001f600 q"]


def _packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class ChunkTable:
    """Encodes texts with begin and end ids, as the library does."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        self.by_chunk = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.begin, self.end = (_packed([i]) for i in (self.sp.bos_id(), self.sp.eos_id()))
        self._empty()
        self.by_chunk = self.by_chunk and all(self.encode([t]) == [self._whole(t)] for t in _PROBES)

    def _empty(self) -> None:
        #: chunk -> its ids, packed; and what chunks decode to, where that is not the chunk itself
        self.ids: dict[str, bytes] = {"": _packed([self.sp.piece_to_id(MARK)])}
        self.other: dict[str, str] = {}

    def _whole(self, text: str) -> tuple[bytes, str]:
        ids = self.sp.encode(text, add_bos=True, add_eos=True)
        return _packed(ids), self.sp.decode(ids)

    def segmented(self, chunks: list[str]) -> list[tuple[str, bytes, str]]:
        """(chunk, its ids, packed, what they decode to) of each."""
        if not chunks:
            return []
        found = [ids if c else [self.sp.piece_to_id(MARK)] for c, ids in zip(chunks, self.sp.encode(chunks, num_threads=1), strict=True)]
        texts = self.sp.decode(found, num_threads=1)
        return [(c, _packed(ids), text if c else "") for c, ids, text in zip(chunks, found, texts, strict=True)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in re.findall(" +[^ ]*", " " + text.replace(MARK, " "))]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text; a null counts as empty."""
        if not self.by_chunk:
            return [self._whole(t or "") for t in texts]
        lists = [self.chunks(t or "") for t in texts]
        wanted = set(chain.from_iterable(lists))
        missing = wanted.difference(self.ids)
        if len(self.ids) + len(missing) > TABLE:
            self._empty()
            missing = wanted.difference(self.ids)
        long = []
        for c, packed, text in self.segmented(list(missing)):
            self.ids[c] = packed
            if text != c:
                self.other[c] = text
            if len(c) > LONGEST:
                long.append(c)
        ids, other = self.ids, self.other
        out = []
        for chunks in lists:
            text = " ".join([other.get(c, c) for c in chunks] if other else chunks)
            out.append((b"".join([self.begin, *map(ids.__getitem__, chunks), self.end]), text))
        for c in long:
            del ids[c]
            other.pop(c, None)
        return out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, model: bytes, columns: list[str], fields: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of a vocabulary file

    def run(batches):
        table = ChunkTable(shared.value)
        for b in slices(batches):
            got = [make(*x) for x in table.encode(b.column("text").to_pylist())]
            kept = [b.column(c) for c in columns]
            made = list(zip(*got, strict=True)) if got else [[] for _ in fields.split(", ")]
            types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            named = [f.split(" ") for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(m, types[t]) for m, (_, t) in zip(made, named, strict=True))], [*columns, *(n for n, _ in named)])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{head}, {fields}")


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (text): each document encoded whole and decoded again.

    A null text counts as empty and has the begin and end ids only. Repeated rows are repeated.
    """
    return _mapped(docs, model, ["doc_id"], "n_tokens long, ids array<int>, decoded string", lambda ids, text: (len(ids) // 4, np.frombuffer(ids, "<i4"), text))


def encoding_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_documents(), with digests of both results."""
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, model, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, digest(ids), digest(text.encode())))


def _blocks(batches):
    """Of each text its block and its chunks' places in the block's list, which stands with the block's first text."""
    part, block, size = TaskContext.get().partitionId() << 33, 0, 0
    places: dict[str, int] = {}
    rows: list = []

    def handed():
        width = "<u2" if len(places) <= 1 << 16 else "<u4"
        packed = [np.array(p, width).tobytes() for _, p in rows]
        lists = [list(places), *[None] * (len(rows) - 1)]
        blocks = pa.array([part + block] * len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([i for i, _ in rows]), blocks, pa.array(packed, pa.binary()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "block", "places", "chunks"])

    for b in slices(batches):
        ids = b.column("doc_id")
        for i, text in enumerate(b.column("text").to_pylist()):
            text = text or ""
            if rows and size + len(text) > BLOCK:
                yield handed()
                block, size = block + 1, 0
                places.clear()
                rows.clear()
            rows.append((ids.slice(i, 1), [places.setdefault(c, len(places)) for c in ChunkTable.chunks(text)]))
            size += len(text)
    if rows:
        yield handed()


def _segmented(shared):
    def run(batches):
        table = ChunkTable(shared.value)
        for b in slices(batches, 20_000):
            made = list(zip(*table.segmented(b.column("chunk").to_pylist()), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.string())], ["chunk", "ids", "decoded"])

    return run


def _joined(ends: tuple[bytes, bytes]):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("place").to_numpy())
        ids = found.column("ids").take(order).to_pylist()
        words = found.column("decoded").take(order).to_pylist()
        width = "<u2" if len(order) <= 1 << 16 else "<u4"
        rows = []
        for packed in texts.column("places").to_pylist():
            at = np.frombuffer(packed, width).tolist()
            rows.append((b"".join([ends[0], *map(ids.__getitem__, at), ends[1]]), " ".join(map(words.__getitem__, at))))
        arrays = [pa.array([len(x) // 4 for x, _ in rows], pa.int64()), pa.array([np.frombuffer(x, "<i4") for x, _ in rows], pa.list_(pa.int32())), pa.array([t for _, t in rows], pa.string())]
        return pa.Table.from_arrays([texts.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encoded_by_table(docs: DataFrame, model: bytes) -> DataFrame:
    """As encode_documents(), each distinct chunk of all texts being segmented once.

    Texts become blocks of about BLOCK characters, each with the list of its distinct chunks and, for each text, its
    chunks' places in that list. The lists' distinct chunks are segmented into a table, which is joined back to the
    lists; a block's texts and its list then meet. A chunk has at most one row for each block, however common.
    """
    table = ChunkTable(model)
    if not table.by_chunk:
        return encode_documents(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = written(docs.select("doc_id", "text").mapInArrow(_blocks, f"doc_id {kind}, block long, places binary, chunks array<string>"), "places")
    lists = texts.filter(F.col("chunks").isNotNull())
    distinct = lists.select(F.explode("chunks").alias("chunk")).distinct()
    segmented = written(distinct.mapInArrow(_segmented(shared), "chunk string, ids binary, decoded string"), "chunks")
    found = lists.select("block", F.posexplode("chunks").alias("place", "chunk")).join(segmented.hint("merge"), "chunk").select("block", "place", "ids", "decoded")
    both = texts.select("doc_id", F.col("block").alias("of"), "places").groupBy("of").cogroup(found.groupBy("block"))
    return both.applyInArrow(_joined((table.begin, table.end)), f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
