"""Byte-pair encoding by last-token states over a prefix trie, and decoding.

A byte-pair encoding of a word is valid exactly if each two neighbouring tokens
are what the merge rules make of their joined bytes, and each prefix of a word
has one encoding.  So an encoding is known from the *last token* of each prefix:
walk back from the end.  The distinct words of a batch form a trie; its
depth-first traversal computes one last token for each node, so a prefix that
many words share is encoded once.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARED_BYTES, SHARED_ROWS, documents, small_batches, worker_cache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts whose characters are all below U+0100: letters, numbers and white space there.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters of text that are cut into pieces at a time, and pieces that are remembered between batches.
CHUNK_CHARS, KEPT_PIECES, KEPT_LENGTH = 2_000_000, 250_000, 48


def vocabulary_file(name: str) -> str:
    """A path as given, or the place of a public vocabulary of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes pieces of text with a byte-level vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, name: str):
        with open(vocabulary_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        named = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [named.get(i, b"") for i in range(max(named) + 1)]
        self.lengths = list(map(len, self.bytes_of))
        merges = [(self.ids[raw(a)], self.ids[raw(b)]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.rank = {a << 32 | b: k for k, (a, b) in enumerate(merges)}
        self.made = {self.ids[self.bytes_of[a] + self.bytes_of[b]]: (a, b, k) for k, (a, b) in enumerate(merges)}
        self.edges: tuple[dict, dict] = ({}, {})
        self.begins = {b[:k] for b in self.ids for k in range(len(b) + 1)}
        #: Suffix states, made as they are met: their bytes, the tokens that end there (longest first, with lengths) and steps.
        self.state_bytes: list[bytes] = [b""]
        self.state_ends: list[tuple] = [()]
        self.state_of: dict[bytes, int] = {b"": 0}
        self.steps: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seen: set[str] = {chr(i) for i in range(128)}
        self.odd: set[str] = set()
        self.cutter = None
        self.file = vocabulary_file(name)
        self.pieces = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """What stands at one edge of a token while the rules build it: (part, rank of the merge that ends it)."""
        known = self.edges[right].get(token)
        if known is None:
            known, part = [(token, 1 << 40)], token
            while part in self.made:
                *halves, rank = self.made[part]
                part = halves[right]
                known.append((part, rank))
            known.reverse()
            self.edges[right][token] = known
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before`` (-1: first) in an encoding.

        It may unless a merge crosses the boundary: one of parts that stand at
        it at the same time, of a rank under that of the merge that takes the
        left part away, and not over that which takes the right part away.
        """
        if before < 0:
            return True
        left, right, i, j = self.edge(before, True), self.edge(token, False), 0, 0
        while True:
            (a, ends_a), (b, ends_b) = left[i], right[j]
            rank = self.rank.get(a << 32 | b)
            if rank is not None and rank < ends_a and rank <= ends_b:
                return False
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                return True

    def step(self, state: int, byte: int) -> int:
        """The longest suffix of ``state`` and one more byte that begins a token."""
        held = self.state_bytes[state] + bytes((byte,))
        while held not in self.begins:
            held = held[1:]
        to = self.state_of.get(held)
        if to is None:
            to = self.state_of[held] = len(self.state_bytes)
            self.state_bytes.append(held)
            ends = ((self.ids.get(held[k:]), len(held) - k) for k in range(len(held)))
            self.state_ends.append(tuple(e for e in ends if e[0] is not None))
        self.steps[state << 8 | byte] = to
        return to

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """``(word, ids)`` for each distinct word, in trie order.

        Sorted words are the leaves of their trie in depth-first order; ``last``
        is the path from the root to the current node with a last token for
        each node, and ``states`` has the tokens that can end there.  Going to
        the next word pops to the shared prefix.
        """
        steps, ends, fits, lengths = self.steps, self.state_ends, self.fits, self.lengths
        last, states, path = [-1], [0], b""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for byte in word[shared:]:
                end += 1
                state = steps.get(state << 8 | byte, -1)
                if state < 0:
                    state = self.step(states[-1], byte)
                states.append(state)
                for token, length in ends[state]:
                    key = (last[end - length] + 1) << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self.follows(last[end - length], token)
                    if ok:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no encoding for {word[:end]!r}")
            path, out, at = word, [], len(word)
            while at:
                token = last[at]
                out.append(token)
                at -= lengths[token]
            out.reverse()
            yield word, out

    def cut(self, text: str) -> list[str]:
        """Pieces of ordinary text, as the ``tokenizers`` library cuts them.

        Texts of Latin letters alone go by a pattern of plain character classes.

        Two Unicode versions may class a character differently: each character
        is probed once with the library, and texts with one that differs are cut
        by the library itself.
        """
        try:
            text.encode("latin-1")
            return LATIN.findall(text)
        except UnicodeEncodeError:
            pass
        if (new := set(text).difference(self.seen)):
            if self.cutter is None:
                from tokenizers import Tokenizer

                self.cutter = Tokenizer.from_file(self.file).pre_tokenizer
            for c in new:
                probe = f"a{c}a1{c}1 {c} .{c}."
                if [probe[i:j] for _, (i, j) in self.cutter.pre_tokenize_str(probe)] != self.pieces.findall(probe):
                    self.odd.add(c)
            self.seen |= new
        if self.odd and not self.odd.isdisjoint(text):
            return [text[i:j] for _, (i, j) in self.cutter.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def split(self, text: str) -> list[str]:
        """Pieces of a text; special strings are pieces of their own."""
        if self.at_special is None or not self.at_special.search(text):
            return self.cut(text)
        return [p for part in self.at_special.split(text) if part for p in ([part] if part in self.special else self.cut(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        collected = gc.isenabled()
        gc.disable()  # millions of short-lived objects, and no cycles
        try:
            return self._encode(texts)
        finally:
            if collected:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            if len(self.young) > KEPT_PIECES:
                # The generation before is forgotten; what is still in use comes over from it.
                self.old, self.young = self.young, {}
            new = set().union(*split).difference(self.young)
            known = {p: self.old[p] for p in new if p in self.old}
            found = {s: array("I", [i]).tobytes() for s, i in self.special.items() if s in new}
            plain = {p.encode(): p for p in new.difference(known, found)}
            found |= {plain[w]: array("I", i).tobytes() for w, i in self.encode_words(plain)}
            self.young |= known
            self.young |= found
            out += [b"".join(map(self.young.__getitem__, pieces)) for pieces in split]
            for p in [p for p in found if len(p) > KEPT_LENGTH]:
                del self.young[p]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            at = end
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encoder(name: str) -> TrieEncoder:
    """One encoder for each worker process and vocabulary, with what it has learnt of pieces."""
    kept = worker_cache("bpe")
    if name not in kept:
        kept[name] = TrieEncoder(name)
    return kept[name]


def encoded(text: str, vocabulary: str) -> Column:
    """Ids of a text column, as binary of little-endian unsigned 32-bit integers (null: none)."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(vocabulary).encode(["" if t is None else t for t in texts]), dtype=object)

    return run(F.col(text))


def decoded(ids: str, vocabulary: str) -> Column:
    """The text of a column of ids (null: empty)."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return pd.Series([e.decode(r or b"") for r in rows], dtype=object)

    return run(F.col(ids))


def bpe_round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids, decoded`` of ``docs(doc_id, text)``, a row per input row.

    A null text counts as empty: no ids, empty decoded text.  Repeated rows stay
    repeated, an empty table stays empty, other columns are ignored and a text
    of any length is one row's work in a worker.
    """
    return small_batches(docs, SHARED_ROWS, SHARED_BYTES).select("doc_id", encoded("text", vocabulary).alias("ids")).withColumn("decoded", decoded("ids", vocabulary))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
