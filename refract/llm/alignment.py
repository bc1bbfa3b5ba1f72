"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

Vocabulary A (byte-level BPE) reads a space and the text, vocabulary B (BPE
pieces) the text, to which it adds that space; both token streams then spell
the same bytes, and the offsets where a token of A and one of B end cut them
into groups.

Fragments.  A byte range's tokens form a :class:`Fragment`: an open prefix (the
tokens up to the first common end), closed groups, and an open suffix (the
tokens after the last common end).  Ranges may be cut at different bytes for A
and B.  :func:`compose` of neighbours aligns the left one's suffix with the
right one's prefix and is associative, so a document longer than ``LONG`` bytes
is cut into byte ranges of about ``PART`` bytes, which are tokens and fragments
in tasks of their own, and a tree of groupings (``FAN`` fragments each)
composes them.  A cuts where its own pattern always parts words, B before a
space behind another sign, where none of its pieces reaches across; so a
fragment's tokens are those of the whole text.

A shorter document is one fragment.  A slice of such documents is one stream
of tokens, in which both vocabularies end where a document ends, so that arrays
hold the work of all of them and no Python code runs per token.

Counts.  Two tokens that end together spell bytes of which one is the end of
the other's.  So the number of different (A id, B id) pairs is bounded by the
two vocabularies, whatever the corpus (:func:`pair_bound`; about 250,000 for
the public ones): their corpus counts are summed by Spark and broadcast.

Defined results: null and empty texts, and texts whose bytes one of the
vocabularies doesn't give back (a U+2581 in the text), have no tokens and
zeros; null and repeated ids are rows like any other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm.common import read, releasing, text_slices, worker_cache
from refract.llm.packing import byte_letters
from refract.session import materialize

#: Texts of more bytes are aligned in parts of about so many, and so many
#: fragments are composed by one step of the tree.
LONG, PART, FAN = 1 << 16, 1 << 15, 8
#: Bytes of text that are aligned at once.
SLICE = 1 << 18
#: Where A's pattern always parts words, in every version of Unicode.
A_CUT = re.compile(r"(?<=\S)(?= )|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")
#: Where no piece of B reaches across.
B_CUT = re.compile(r"(?<=\S)(?= )")
#: Signs that every version of Unicode knows alike: Latin letters, dashes, quotes.
_LATIN = re.compile("[\0-\u024f\u2010-\u2027]*")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ALIGNED = "id {id}, rid long, n_a long, n_b long, n_groups long, links array<long>, groups string"
PARTS = "id {id}, rid long, part int, a string, b string, a_at long, b_at long, bytes long"
FRAGMENT = ("id {id}, rid long, part int, ok boolean, n_a long, n_b long, closed boolean, "
            "pa array<int>, pa_end array<long>, pb array<int>, pb_end array<long>, n_groups long, links array<long>, groups string, "
            "sa array<int>, sa_end array<long>, sb array<int>, sb_end array<long>")


def paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"not a plain byte-level vocabulary: {a_path}")
        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(*vocab.values(), *special, -1) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = special[i] if i in special else bytes(letters[c] for c in token)
        # the same merges in the same order, for words whose signs every version of Unicode knows alike
        self.latin = tiktoken.Encoding("a", pat_str=_PATTERN, special_tokens={}, mergeable_ranks={
            b: i for i, b in enumerate(self.a_bytes) if b and i not in special})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError(f"pieces reach across words: {b_path}")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.pieces.piece_to_id("▁")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def a(self, texts: list[str]) -> list[list[int]]:
        out: list = [self.latin.encode_ordinary(t) if _LATIN.fullmatch(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def b(self, texts: list[str]) -> list[list[int]]:
        """Of texts behind a space; an empty one is the space alone, for which
        the library adds none."""
        if not texts:
            return []
        return [x or [self.space] for x in self.pieces.encode(texts, num_threads=1)]

    def streams(self, texts: list[str]) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens of all texts, each behind a space, one after another; ends of
        each text's tokens of A and of B).  A text that one of the two doesn't
        spell has none."""
        a, b = self.a([" " + t for t in texts]), self.b(texts)
        spelt = [(" " + t).encode() for t in texts]
        for k, x in enumerate(spelt):
            if not (spells(a[k], self.a_bytes, x) and spells(b[k], self.b_bytes, x)):
                a[k], b[k] = [], []
        return (Tokens(*self.ends(a, self.a_len), *self.ends(b, self.b_len)),
                *[np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b)])

    @staticmethod
    def ends(ids: list[list[int]], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        return flat, np.cumsum(length[flat])


def spells(ids: list[int], table: list[bytes], text: bytes) -> bool:
    return b"".join(map(table.__getitem__, ids)) == text


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Loaded once for each worker; their size is that of the files."""
    held = worker_cache("vocabularies")
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Vocabularies(a_path, b_path)
    return held[a_path, b_path]


def pair_bound(v: Vocabularies) -> int:
    """How many (A id, B id) there are of which one's bytes end the other's."""
    a, b = {}, {}
    for table, held in ((v.a_bytes, a), (v.b_bytes, b)):
        for x in table:
            held[x] = held.get(x, 0) + 1
    longer = sum(b.get(x[i:], 0) for x in v.a_bytes for i in range(len(x)))
    return longer + sum(a.get(x[i:], 0) for x in v.b_bytes for i in range(1, len(x)))


# ------------------------------------------------------------- fragments
class Tokens(NamedTuple):
    """Ids and the offsets at which they end, of both vocabularies."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def cut(self, a0, a1, b0, b1) -> Tokens:
        return Tokens(self.a[a0:a1], self.a_end[a0:a1], self.b[b0:b1], self.b_end[b0:b1])

    def __add__(self, other) -> Tokens:
        return Tokens(*map(np.concatenate, zip(self, other)))


NO_TOKENS = Tokens(*[np.zeros(0, np.int64)] * 4)


class Groups(NamedTuple):
    """Closed groups: how many, their links (pair numbers), their text."""

    n: int
    links: np.ndarray
    text: str


class Fragment(NamedTuple):
    """``closed``: some end is common; without one all tokens are in ``prefix``."""

    n_a: int
    n_b: int
    closed: bool
    prefix: Tokens
    groups: Groups
    suffix: Tokens


NO_GROUPS = Groups(0, np.zeros(0, np.int64), "")
EMPTY = Fragment(0, 0, False, NO_TOKENS, NO_GROUPS, NO_TOKENS)


def common_ends(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places just after the tokens of A and of B that end together."""
    if not len(t.a) or not len(t.b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.minimum(np.searchsorted(t.b_end, t.a_end), len(t.b_end) - 1)
    i = np.flatnonzero(t.b_end[j] == t.a_end)
    return i + 1, j[i] + 1


def group_texts(t: Tokens, i: np.ndarray, j: np.ndarray) -> pa.Array:
    """``a1,a2|b1`` of each group; ``i`` and ``j`` are the ends of all groups,
    which begin with the first tokens."""
    sides = []
    for ids, ends in ((t.a, i), (t.b, j)):
        n = int(ends[-1]) if len(ends) else 0
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(ids[:n]).cast(pa.string()))
        sides.append(pc.binary_join(lists, ","))
    return pc.binary_join_element_wise(*sides, "|")


def texts_of(groups: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The groups of each document, one behind another, as a text."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([first[:1], last])), groups)
    return pc.binary_join(lists, ";")


def groups_of(t: Tokens, size_b: int) -> tuple[Groups, Tokens]:
    """The groups of tokens that follow a common end, and what stays open."""
    i, j = common_ends(t)
    if not len(i):
        return NO_GROUPS, t
    return (Groups(len(i), t.a[i - 1] * size_b + t.b[j - 1], texts_of(group_texts(t, i, j), np.zeros(1, np.int64), np.array([len(i)]))[0].as_py()),
            t.cut(i[-1], None, j[-1], None))


def fragment(t: Tokens, size_b: int) -> Fragment:
    i, j = common_ends(t)
    if not len(i):
        return Fragment(len(t.a), len(t.b), False, t, NO_GROUPS, NO_TOKENS)
    groups, suffix = groups_of(t.cut(i[0], None, j[0], None), size_b)
    return Fragment(len(t.a), len(t.b), True, t.cut(0, i[0], 0, j[0]), groups, suffix)


def joined(*parts: Groups) -> Groups:
    some = [p for p in parts if p.n]
    return Groups(sum(p.n for p in some), np.concatenate([p.links for p in some]), ";".join(p.text for p in some)) if some else NO_GROUPS


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """Of two neighbours; associative, with :data:`EMPTY` for no bytes."""
    n_a, n_b = x.n_a + y.n_a, x.n_b + y.n_b
    middle = (x.suffix if x.closed else x.prefix) + y.prefix
    if x.closed:
        groups, left = groups_of(middle, size_b)
        return Fragment(n_a, n_b, True, x.prefix, joined(x.groups, groups, y.groups), y.suffix if y.closed else left)
    z = fragment(middle, size_b)
    if not y.closed:
        return z._replace(n_a=n_a, n_b=n_b)
    return Fragment(n_a, n_b, True, z.prefix, joined(z.groups, y.groups), y.suffix)


def finished(x: Fragment, size_b: int) -> Groups:
    """The groups of a whole document: its prefix is one, its suffix is empty."""
    return joined(groups_of(x.prefix, size_b)[0], x.groups)


# ------------------------------------------------------------- short texts
def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(kind)))


def _rows(ids, rids, n_a, n_b, n_groups, links: pa.Array, groups: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, rids, *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], links, groups],
                                      ["id", "rid", "n_a", "n_b", "n_groups", "links", "groups"])


def _short(files: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*files)
        for b in text_slices(batches, "text", SLICE):
            texts = pc.fill_null(b.column("text"), "").to_pylist()
            some = np.flatnonzero(np.fromiter(map(bool, texts), bool, len(texts)))
            t, a_end, b_end = v.streams([texts[k] for k in some])
            # of each row, also of those without text
            row_end = [np.cumsum(np.bincount(some, weights=np.diff(x, prepend=0), minlength=len(texts)).astype(np.int64)) for x in (a_end, b_end)]
            i, j = common_ends(t)
            last = np.searchsorted(i, row_end[0], "right")
            first = np.concatenate([[0], last[:-1]])
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), pa.array(t.a[i - 1] * len(v.b_bytes) + t.b[j - 1]))
            yield _rows(b.column("id"), b.column("rid"), *[np.diff(x, prepend=0) for x in row_end], last - first, links,
                        texts_of(group_texts(t, i, j), first, last))
    return releasing(run)


# ------------------------------------------------------------- long texts
def cuts(text: str, where: re.Pattern, size: int) -> list[int]:
    """0, then the first place ``where`` may cut after each ``size`` characters,
    then the end; a stretch without such a place stays whole."""
    out, at = [0], size
    while at < len(text) and (m := where.search(text, at)):
        out.append(m.start())
        at = max(at + size, m.start() + 1)
    return [*out, len(text)]


def parts_of(text: str, size: int) -> list[tuple[str, str, int, int]]:
    """(bytes of A, bytes of B, and the offsets at which they begin) of the
    byte ranges of a space and ``text``; what one of the two lacks is empty."""
    whole = " " + text
    sides = []
    for where in (A_CUT, B_CUT):
        c = cuts(whole, where, size)
        part = [whole[s:e] for s, e in zip(c, c[1:])]
        sides.append((part, np.concatenate([[0], np.cumsum([len(p.encode()) for p in part])]).tolist()))
    (a, a_at), (b, b_at) = sides
    n = max(len(a), len(b))
    return [(a[k] if k < len(a) else "", b[k] if k < len(b) else "", a_at[min(k, len(a))], b_at[min(k, len(b))]) for k in range(n)]


def _parts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):                # a row at a time: each is long
                b = batch.slice(i, 1)
                found = parts_of(b.column("text")[0].as_py(), size)
                take = pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("rid").take(take), pa.array(np.arange(len(found), dtype=np.int32)),
                     *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                     pa.array([len(f[0].encode()) + len(f[1].encode()) for f in found], pa.int64())],
                    ["id", "rid", "part", "a", "b", "a_at", "b_at", "bytes"])
    return run


def tokens_of(v: Vocabularies, a: str, b: str, a_at: int, b_at: int) -> tuple[Tokens, bool]:
    """The tokens of a part, and whether they spell it."""
    ia = v.a([a])[0] if a else []
    ib = v.b([b[1:]])[0] if b else []
    if not (spells(ia, v.a_bytes, a.encode()) and spells(ib, v.b_bytes, b.encode())):
        return NO_TOKENS, False
    (ia, a_end), (ib, b_end) = v.ends([ia], v.a_len), v.ends([ib], v.b_len)
    return Tokens(ia, a_at + a_end, ib, b_at + b_end), True


def _fragment_rows(ids, rids, parts: list[int], found: list[tuple[bool, Fragment]]) -> pa.RecordBatch:
    f = [x for _, x in found]
    side = lambda t: [_lists([getattr(x, t)[k] for x in f], np.int64 if k % 2 else np.int32) for k in range(4)]
    col = lambda k: pa.array([x[k] for x in f], pa.bool_() if k == 2 else pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, rids, pa.array(parts, pa.int32()), pa.array([ok for ok, _ in found], pa.bool_()), col(0), col(1), col(2), *side("prefix"),
         pa.array([x.groups.n for x in f], pa.int64()), _lists([x.groups.links for x in f], np.int64),
         pa.array([x.groups.text for x in f], pa.string()), *side("suffix")],
        ["id", "rid", "part", "ok", "n_a", "n_b", "closed", "pa", "pa_end", "pb", "pb_end", "n_groups", "links", "groups", "sa", "sa_end", "sb", "sb_end"])


def _fragments(files: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*files)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                t, ok = tokens_of(v, *[b.column(c)[0].as_py() for c in ("a", "b", "a_at", "b_at")])
                yield _fragment_rows(b.column("id"), b.column("rid"), b.column("part").to_pylist(), [(ok, fragment(t, len(v.b_bytes)))])
    return releasing(run)


def _read_fragments(t: pa.Table) -> Iterator[tuple[bool, Fragment]]:
    for k in range(t.num_rows):
        row = {c: t.column(c)[k] for c in t.column_names}
        ints = lambda c: row[c].values.to_numpy().astype(np.int64)
        tokens = lambda s: Tokens(*[ints(s + c) for c in ("a", "a_end", "b", "b_end")])
        yield row["ok"].as_py(), Fragment(row["n_a"].as_py(), row["n_b"].as_py(), row["closed"].as_py(), tokens("p"),
                                          Groups(row["n_groups"].as_py(), ints("links"), row["groups"].as_py()), tokens("s"))


def _composed(size_b: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ok, f = True, EMPTY
        for good, x in _read_fragments(t):
            ok, f = ok and good, compose(f, x, size_b)
        first = t.slice(0, 1)
        return pa.Table.from_batches([_fragment_rows(first.column("id").combine_chunks(), first.column("rid").combine_chunks(),
                                                     [first.column("part")[0].as_py() // FAN], [(ok, f if ok else EMPTY)])])
    return run


def _documents(size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(f.n_a, f.n_b, finished(f, size_b)) if ok else (0, 0, NO_GROUPS) for ok, f in _read_fragments(pa.Table.from_batches([b]))]
            yield _rows(b.column("id"), b.column("rid"), [f[0] for f in found], [f[1] for f in found], [f[2].n for f in found],
                        _lists([f[2].links for f in found], np.int64), pa.array([f[2].text for f in found], pa.string()))
    return run


def _long(docs: DataFrame, files: tuple[str, str], id_type: str, part: int) -> DataFrame | None:
    """The aligned long documents; None if there are none."""
    size_b = len(vocabularies(*files).b_bytes)
    cut = materialize(docs.mapInArrow(_parts(part), PARTS.format(id=id_type)), "textparts")
    last, size = cut.agg(F.max("part"), F.sum("bytes")).first()
    if last is None:
        return None
    tasks = max(cut.sparkSession.sparkContext.defaultParallelism, -(-size // (64 * part)))
    schema = FRAGMENT.format(id=id_type)
    f = materialize(cut.repartition(tasks, "rid", "part").mapInArrow(_fragments(files), schema), "fragments")
    while last > 0:
        f = materialize(f.groupBy("rid", F.floor(F.col("part") / FAN)).applyInArrow(_composed(size_b), schema), "fragments")
        last //= FAN
    return f.mapInArrow(_documents(size_b), ALIGNED.format(id=id_type))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None,
          files: tuple[str, str] | None = None, long: int = LONG, part: int = PART) -> DataFrame:
    """One row per input row: ``id``, ``rid`` (``key``, or a number made here),
    ``n_a``, ``n_b``, ``n_groups``, ``links`` (``A id * size of B + B id`` of
    each pair of tokens that end together), ``groups`` (``a1,a2|b1;a3|b2,b3``).
    ``files``: the vocabularies' files on every worker."""
    files = files or paths()
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    short = d.where(~is_long).mapInArrow(_short(files), ALIGNED.format(id=kind))
    more = _long(d.where(is_long), files, kind, part)
    return short if more is None else short.unionByName(more)


# ------------------------------------------------------------- counts
def link_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` links; one row with more is a run."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(b.column("links")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        s = 0
        while s < b.num_rows:
            e = max(s + 1, int(np.searchsorted(upto, most + (upto[s - 1] if s else 0), "right")))
            yield b.slice(s, e - s)
            s = e


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in link_slices(batches):
        new, m = np.unique(pc.list_flatten(b.column(0)).to_numpy(zero_copy_only=False), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n, m]), minlength=len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n``: how many links hold it; at most :func:`pair_bound` rows."""
    return (aligned.select("links").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))


def _scored(model, size_b: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = model.value
        best = np.zeros(size_b, np.int64)
        np.maximum.at(best, pair % size_b, n)
        is_best = n == best[pair % size_b]
        for b in link_slices(batches):
            links = b.column("links")
            at = np.searchsorted(pair, pc.list_flatten(links).to_numpy(zero_copy_only=False))
            size = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (is_best[at].astype(np.int64), n[at])]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(size), *[pa.array(s[end] - s[end - size]) for s in sums]],
                [*keep, "n_links", "n_best", "count_sum"])
    return releasing(run)


def score(aligned: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``aligned`` (stored: it is read twice) with ``n_links``, ``n_best`` and
    ``count_sum`` in place of ``links``."""
    size_b = len(vocabularies(*(files or paths())).b_bytes)
    t = pair_counts(aligned).orderBy("pair").toArrow()               # bounded by the vocabularies
    model = aligned.sparkSession.sparkContext.broadcast(tuple(t.column(c).combine_chunks().to_numpy() for c in ("pair", "n")))
    keep = [c for c in aligned.columns if c != "links"]
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in keep) + ", n_links long, n_best long, count_sum long"
    return aligned.mapInArrow(_scored(model, size_b, keep), schema)


def query(spark, sf_dir: str) -> DataFrame:
    a = align(read(spark, sf_dir, "documents"))
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    stored = materialize(a.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "links", sha.alias("groups_sha256")), "aligned")
    return score(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
