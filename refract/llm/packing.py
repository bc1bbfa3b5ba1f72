"""Best-fit packing of tokenized documents into sequences.

Only documents longer than a sequence are cut.  Full pieces are sequences of
their own.  The others are dealt by a hash of their key over shards of bounded
size; in each shard best-fit decreasing puts a piece into the open sequence
with the least room that still takes it.  The open sequences are held by
remaining room, and a segment tree over the rooms 0..capacity finds the
tightest one in logarithmic time.  A shard leaves at most about one sequence
partly filled, so sharding costs one sequence in thousands.

Defined results: a null text is an empty one and takes one token (the end
mark); null and repeated ids are rows like any other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm.common import read, releasing, text_slices, worker_cache
from refract.session import materialize

CAPACITY = 4096
END_ID = 1
#: Bounds of what one task packs.
SHARD_TOKENS, SHARD_PIECES = 1 << 26, 1 << 17
#: Distinct words whose ids a task remembers; beyond, the less frequent half goes.
CACHE_WORDS = 1 << 18
#: Of these, how many a worker keeps for its next task.
KEPT_WORDS = 1 << 17
#: Text bytes encoded at once.
ENCODE_BYTES = 1 << 20

PIECE = "doc_id {id}, rid long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters only (ASCII and the Latin-1 letters) are lower-cased
#: and split the same way by every Unicode version; other words go through the
#: tokenizer as they are.  ``<|`` begins the vocabulary's special strings.
PLAIN = re.compile(r"(?:(?!<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])+")
#: The vocabulary's own rule for parts of a lower-cased word, for such characters.
PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class Encoder:
    """Token ids of texts.  The vocabulary splits at white space and drops it,
    so a text's ids are those of its words one after another; each distinct
    word is encoded once and remembered (at most ``CACHE_WORDS``; between tasks a
    worker keeps ``KEPT_WORDS`` of them)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = worker_cache("tokens")
        if path not in held:
            from tokenizers import Tokenizer
            held[path] = Tokenizer.from_file(path)
        self.held: dict = worker_cache("words").setdefault(path, {})
        self.tokenizer = held[path]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        if "words" not in self.held:
            self._forget()

    def _forget(self) -> None:
        self.held.update(words={}, parts={}, begin=np.zeros(0, np.int64), size=np.zeros(0, np.int64),
                         flat=np.zeros(0, np.uint32), times=np.zeros(0, np.int64))

    def _keep_frequent(self) -> None:
        held, names = self.held, list(self.held["words"])               # in the order of their places
        some = np.sort(np.argsort(held["times"], kind="stable")[len(names) // 2:])
        begin, size = held["begin"][some], held["size"][some]
        first = np.cumsum(size) - size
        flat = held["flat"][np.arange(int(size.sum())) + np.repeat(begin - first, size)]
        held.update(words={names[i]: k for k, i in enumerate(some.tolist())}, parts={}, begin=first, size=size, flat=flat,
                    times=held["times"][some] // 2)

    def rest(self) -> None:
        """Keep the most frequent words only, until the next task."""
        while len(self.held["words"]) > KEPT_WORDS:
            self._keep_frequent()
        self.held["parts"] = {}

    def _ids(self, part: str) -> tuple[int, ...]:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return tuple([t.id for t in self.model.tokenize(shown)])

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of words that aren't known yet."""
        held, known = self.held, self.held["parts"]
        plain = [w if PLAIN.fullmatch(w) else "" for w in new]
        parts = PARTS.findall("\n".join(plain).lower())     # "\n" comes out as a part
        for p in set(parts).difference(known):
            known[p] = self._ids(p)
        lists: list = [()]
        for p in parts:
            if p == "\n":
                lists.append(())
            else:
                lists[-1] += known[p]
        odd = [i for i, w in enumerate(plain) if not w]
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([new[i] for i in odd], add_special_tokens=False)):
                lists[i] = e.ids
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(held["flat"])
        held["words"].update(zip(new, range(len(held["size"]), len(held["size"]) + len(new))))
        held["begin"] = np.concatenate([held["begin"], first + np.cumsum(size) - size])
        held["size"] = np.concatenate([held["size"], size])
        held["flat"] = np.concatenate([held["flat"], np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        off = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [np.zeros(0, np.uint32)] * len(texts)
        # no word holds a line feed: one string for all is the quick way out of Arrow
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        names = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")
        if len(self.held["words"]) + len(names) > CACHE_WORDS:
            self._keep_frequent()
        known = self.held["words"]
        found = list(map(known.get, names))
        new = [w for w, i in zip(names, found) if i is None]
        if new:
            at = iter(range(len(self.held["size"]), len(self.held["size"]) + len(new)))
            self._learn(new)
            found = [next(at) if i is None else i for i in found]
        word = np.array(found, np.int64)[coded.indices.to_numpy()]
        times = np.bincount(word, minlength=len(self.held["size"]))
        times[:len(self.held["times"])] += self.held["times"]
        self.held["times"] = times
        n = self.held["size"][word]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(int(upto[-1])) - np.repeat(upto[:-1] - self.held["begin"][word], n)
        ids, off = self.held["flat"][at], off - off[0]
        return [ids[upto[off[i]]:upto[off[i + 1]]] for i in range(len(texts))]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        mark = np.array([end_id], "<u4")
        for b in text_slices(batches, "text", ENCODE_BYTES):
            row, piece, length, crc = [], [], [], []
            for i, ids in enumerate(enc.encode(b.column("text"))):
                ids = np.concatenate([ids, mark]).astype("<u4")
                for p in range(0, len(ids), capacity):
                    part = ids[p:p + capacity]
                    row.append(i)
                    piece.append(p // capacity)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            take = pa.array(row, pa.int64())
            piece = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("rid").take(take), pa.array(piece.astype(np.int32)),
                 pa.array(piece * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "rid", "piece", "start", "length", "ids_crc32"])
        enc.rest()
    return releasing(run)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and cut.  ``path``: the vocabulary's file on every worker."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                    F.col(text_col).alias("text"))
    return d.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id),
                        PIECE.format(id=docs.schema[id_col].dataType.simpleString()))


class Rooms:
    """Segment tree over remaining rooms 0..capacity: which of them some open
    sequence has.  ``tightest(n)``: the least such room that is n or more."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        i = room + self.size
        self.any[i] = on
        i >>= 1
        while i:
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                return
            self.any[i] = now
            i >>= 1

    def tightest(self, n: int) -> int:
        """-1: none."""
        i = n + self.size
        if self.any[i]:
            return n
        while i > 1:
            if not i & 1 and self.any[i + 1]:    # a right neighbour's subtree has one
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the lengths are placed in the order in
    which they come, which is decreasing for best-fit decreasing."""
    rooms, open_ = Rooms(capacity), {}
    bins, offsets, made = [], [], 0
    for n in lengths.tolist():
        room = rooms.tightest(n)
        if room < 0:
            room, b = capacity, made
            made += 1
        else:
            held = open_[room]
            b = held.pop()
            if not held:
                rooms.set(room, False)
        bins.append(b)
        offsets.append(capacity - room)
        left = room - n
        if left:
            held = open_.setdefault(left, [])
            if not held:
                rooms.set(left, True)
            held.append(b)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("rid", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        shard = table.column("shard").to_numpy().astype(np.int64)
        out = table.drop_columns(["shard"])
        return (out.append_column("sequence_id", pa.array((shard + 1 << 32) + bins))
                .append_column("offset", pa.array(offsets)))
    return run


def pack(p: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to :func:`pieces`."""
    p = materialize(p, "pieces")
    part = p.where(F.col("length") < capacity)
    n, tokens = part.agg(F.count(F.lit(1)), F.sum("length")).first()
    shards = max(1, math.ceil((tokens or 0) / shard_tokens), math.ceil(n / shard_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + ", sequence_id long, offset long"
    packed = (part.withColumn("shard", F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("int"))
              .groupBy("shard").applyInArrow(_pack(capacity), schema))
    full = p.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents"))).drop("rid")
