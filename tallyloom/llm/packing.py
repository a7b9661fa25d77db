"""Packing token sequences into fixed windows: best-fit decreasing over a segment tree of capacities."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_file
from .common import Stored, documents, small_batches, worker_cache

#: Tokens of pieces that a task holds before it packs them and goes on, and words that a tokenizer remembers.
HELD_TOKENS, KEPT_WORDS, KEPT_LENGTH = 2_000_000, 100_000, 48
#: Windows filled to less than this share are packed again, together with those of other partitions.
FILLED = 0.99
#: Sequences of the second pass count up from here, those of the first from their partition's number; both times 2**33.
AGAIN = 1 << 29

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
FIRST = PIECES + ", again boolean"
ARROW = pa.schema([(c.split()[0], {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}[c.split()[1]]) for c in FIRST.split(", ")])


#: A word of lower-case Latin letters that no normalizer changes and no piece pattern cuts, and a mark after it.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,]?)\Z")


class WordMerger:
    """Byte-pair merges of many words in one call, for vocabularies whose words end in a suffix.

    The merges run in ``tiktoken``: the suffix becomes a zero byte, joined to
    the last byte before all else, and every other token keeps its order.  That
    gives the library's ids as long as each token's own text encodes to that
    token, which the tests check for all words of a corpus.
    """

    def __init__(self, spec: dict, suffix: str):
        import tiktoken

        self.suffix = suffix
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t.removesuffix(suffix)) + (b"\0" if t.endswith(suffix) else b"")
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        single = [raw(c) for c in letters]
        ends = [b + b"\0" for b in single]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = dict.fromkeys([*single, b"\0", *ends, *map(raw, merged)])
        ranks = {b: k for k, b in enumerate(order)}
        ids = {raw(t): i for t, i in vocab.items()}
        self.id_of = np.array([ids.get(b, 0) for b in order], dtype="<u4")
        self.last = np.array([b.endswith(b"\0") for b in order])
        self.engine = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, file: str) -> WordMerger | None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        return cls(spec, suffix) if suffix else None

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        got = np.array(self.engine.encode_ordinary(b"\0 ".join(words).decode() + "\0"), dtype=np.int64)
        ids = self.id_of[got].tobytes()
        ends = ((np.flatnonzero(self.last[got]) + 1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class WordTokenizer:
    """Ids by the ``tokenizers`` library, once for each distinct word.

    For vocabularies whose pieces never span a space, as those that drop white
    space: a text's ids are then those of its space-separated words in order.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_file(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("A") == "a"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {m: self.ids_of([m.decode()])[0] if m else b"" for m in (b".", b",", b"")}
        self.merger = WordMerger.of(vocabulary_file(name)) if self.lower else None
        if self.merger and not self.agrees():
            self.merger = None

    def ids_of(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def agrees(self, most: int = 4096) -> bool:
        """Whether the merger gives the library's ids for plain words of the vocabulary, whole and run together."""
        whole = [w.removesuffix(s) for w in self.library.get_vocab() if (s := self.merger.suffix) and w.endswith(s)]
        whole = sorted(w for w in whole if PLAIN.fullmatch(w.encode()))
        words = whole[:: 1 + len(whole) // most]
        words += [a + b for a, b in zip(words, reversed(words), strict=True)]
        return self.merger.ids_of([w.encode() for w in words]) == self.ids_of(words)

    def learn(self, words: list[bytes]) -> None:
        """Ids of words not met before.

        Plain words go to a byte-pair merger in one call.  A full stop or comma
        after a letter is a piece of its own.  All others go to the library.
        """
        young, old, marks = self.young, self.old, self.marks
        plain: list[tuple[bytes, bytes, bytes]] = []
        other: list[bytes] = []
        for w in words:
            known = old.get(w)
            if known is not None:
                young[w] = known
                continue
            m = PLAIN.match(w) if self.merger else None
            if m:
                plain.append((w, m[1], marks[m[2]]))
            else:
                other.append(w)
        if plain:
            cores = list({core for _, core, _ in plain if core not in young})
            young.update(zip(cores, self.merger.ids_of(cores), strict=True))
            for w, core, mark in plain:
                if mark:
                    young[w] = young[core] + mark
        for at in range(0, len(other), 8192):
            part = other[at : at + 8192]
            young.update(zip(part, self.ids_of([w.decode() for w in part]), strict=True))

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        if self.lower and b"<|" not in text:
            text = text.lower()  # A-Z only; the library does the rest, special strings are matched before it
        words = text.replace(b"\n", b" ").split(b" ")
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        new = set(words).difference(self.young)
        if new:
            self.learn(list(new))
        out = b"".join(map(self.young.__getitem__, words))
        for w in new:
            if len(w) > KEPT_LENGTH:
                del self.young[w]
        return out


def tokenizer(name: str) -> WordTokenizer:
    kept = worker_cache("packing")
    if name not in kept:
        kept[name] = WordTokenizer(name)
    return kept[name]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest fit in log(window) steps."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        node = capacity + self.leaves
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """``(capacity, window)`` with the least capacity that is ``need`` or more; it is taken out."""
        node = need + self.leaves
        if not self.any[node]:
            # Climb until a right sibling, all of which holds more, has a window; then take its least.
            while node & 1 or not self.any[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.any[node]:
                node += 1
        capacity = node - self.leaves
        number = self.at[capacity].pop()
        while node:
            self.any[node] -= 1
            node >>= 1
        return capacity, number


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """For each length, which window it goes to and at which offset; and how many windows there are."""
    tree, count = OpenWindows(window), 0
    to, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = tree.take(need)
        if found is None:
            capacity, number = window, count
            count += 1
        else:
            capacity, number = found
        to[i], offset[i] = number, window - capacity
        if capacity > need:
            tree.put(capacity - need, number)
    return to, offset, count


def tokenized(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple]:
    """``(doc_id, ids)`` for each row of ``doc_id`` and UTF-8 ``text``, each document ending in ``end_id``."""
    end = np.array([end_id], dtype="<u4").tobytes()
    t = tokenizer(vocabulary)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            yield doc_id, (t.encode(text) if text else b"") + end


def pieces_of(rows: Iterator[tuple], window: int) -> Iterator[tuple]:
    """``(doc_id, start, ids, doc_tokens)``: documents cut into full windows and a rest."""
    for doc_id, ids in rows:
        for start in range(0, len(ids) // 4, window):
            yield doc_id, start, ids[4 * start : 4 * (start + window)], len(ids) // 4


def packed(rows: Iterator[tuple], window: int, task: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``FIRST`` for ``(doc_id, ids)`` rows."""
    return packed_pieces(pieces_of(rows, window), window, task)


def packed_pieces(pieces: Iterator[tuple], window: int, task: int, filled: float = FILLED) -> Iterator[pa.RecordBatch]:
    """Batches of ``FIRST`` for pieces as :func:`pieces_of` gives them.

    Full windows go out at once; the others wait until ``HELD_TOKENS`` are
    there and are then packed.  Pieces of windows that are filled to less than
    ``filled`` are marked to be packed again.
    """
    sequence, held, tokens = task << 33, [], 0
    out: list[tuple] = []

    def frames() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 1024], strict=True), ARROW, strict=True)], schema=ARROW)
        out.clear()

    def pack() -> None:
        nonlocal sequence, tokens
        lengths = [len(p[2]) // 4 for p in held]
        to, offset, count = best_fit_decreasing(lengths, window)
        used = [0] * count
        for k, n in zip(to, lengths, strict=True):
            used[k] += n
        for (doc_id, start, ids, n), k, at in zip(held, to, offset, strict=True):
            out.append((doc_id, start, len(ids) // 4, ids, n, sequence + k, at, used[k] < filled * window))
        sequence += count
        tokens = 0
        held.clear()

    for doc_id, start, ids, n in pieces:
        if len(ids) == 4 * window:
            out.append((doc_id, start, window, ids, n, sequence, 0, False))
            sequence += 1
        else:
            held.append((doc_id, start, ids, n))
            tokens += len(ids) // 4
        if tokens > HELD_TOKENS:
            pack()
        if len(out) >= 1024:
            yield from frames()
    pack()
    yield from frames()


def pack_documents(docs: DataFrame, window: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``window`` tokens, with their ids.

    Each input partition is packed by itself, and stored; what it leaves in
    windows that are not full is packed again, that of many partitions
    together, so that padding does not depend on how the input is cut.  A task
    holds ``HELD_TOKENS`` tokens at most.  ``sequence_id`` counts up from the
    partition number, so a task that runs again gives the same rows.  A null or
    empty text is its end id alone; repeated rows and ids are packed each;
    other columns are ignored; an empty table gives no rows.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(tokenized(batches, vocabulary, end_id), window, TaskContext.get().partitionId())

    def once_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        for batch in packed_pieces(rows, window, AGAIN + TaskContext.get().partitionId(), 0.0):
            yield batch.select(names)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    first = Stored(rows.mapInArrow(run, FIRST), "pieces", "zstd").df
    rest = first.where("again").select("doc_id", "start", "length", "ids", "doc_tokens")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    rest = rest.repartition(1 + tokens // HELD_TOKENS, "doc_id", "start", "ids").sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids")
    return first.where("not again").select(*names).unionByName(rest.mapInArrow(once_more, PIECES))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(documents(spark, sf_dir)))
