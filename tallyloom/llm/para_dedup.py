"""Near-duplicate passages: MinHash banding of paragraphs, exact Jaccard, components, removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Stored, components, documents, small_batches, worker_cache
from .repeats import RUN_WORDS, Runs, anchors, cut_column, runs_of, stretches

#: Words of a shingle, least similarity, and least words of a paragraph that may be removed.
WIDTH, THRESHOLD, MIN_WORDS = 5, 0.8, 40
#: A pair of similarity 0.8 meets in one of 8 bands of 3 rows with probability 0.997.
BANDS, ROWS = 8, 3
#: Buckets up to this size are compared pair by pair; larger ones through their commonest member.
PAIRED = 24
#: A shingle is rare if at most so many of the paragraphs in large buckets have it.
RARE = 8

_ODD = (np.random.default_rng(20_240_229).integers(1, 1 << 63, size=(BANDS * ROWS, 2), dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole, if it is shorter."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, one row for each non-empty set of shingles."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), BANDS * ROWS), dtype=np.uint64)
    for k, (a, b) in enumerate(_ODD):
        mixed = flat * a
        mixed ^= mixed >> np.uint64(32)
        least[:, k] = np.minimum.reduceat(mixed * b, starts)
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = (keys ^ least[:, r::ROWS]) * _STEP
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


READ = "kind int, doc_id long, tk long, start int, end int, x long, y long, " + ", ".join(f"b{k} long" for k in range(BANDS))
FETCHED = "kind int, id long, set binary, off int, w long, least long, most long"
#: Kinds of rows of the two passes over texts.
PARAGRAPHS, RUNS = 0, 1


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _words(line: str) -> list[bytes]:
    return line.encode().lower().split()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _paragraphs(lines: list[str], counts: list[int], min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """``start, end`` in code points and in words of each paragraph of ``min_words`` words or more: lines of so many, and
    rows of shorter lines up to a blank or a long one."""
    at = word = 0
    short: list[tuple[int, int, int, int]] = []
    for line, n in zip([*lines, ""], [*counts, 0], strict=True):
        if 0 < n < min_words:
            short.append((at, at + len(line), word, word + n))
        else:
            if len(short) > 1 and short[-1][3] - short[0][2] >= min_words:
                yield short[0][0], short[-1][1], short[0][2], short[-1][3]
            short = []
            if n:
                yield at, at + len(line), word, word + n
        at += len(line) + 1
        word += n


def read_texts(docs: DataFrame, min_words: int | None, run_words: int | None) -> DataFrame:
    """One pass over ``docs(doc_id, text)``: rows of paragraphs and of stretches (``READ``).

    A paragraph has its place in code points, a 128-bit key of its words and
    its band keys; a stretch (see :func:`repeats.anchors`) its first window,
    its number of windows, the hash of its gram and that of all its words.
    ``tk`` is a hash of the text, so that rows of one id stay apart.
    """
    schema = _schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("passages")
        rows: list[tuple] = []
        sets: list[np.ndarray] = []
        runs: list[tuple] = []
        size = 0

        def frames() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if rows:
                doc, tk, start, end, digests = zip(*rows, strict=True)
                keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                bands = signatures(sets)
                yield _batch(schema, {"kind": np.full(len(rows), PARAGRAPHS), "doc_id": doc, "tk": tk, "start": start, "end": end, "x": np.ascontiguousarray(keys[:, 0]), "y": np.ascontiguousarray(keys[:, 1])} | {f"b{k}": np.ascontiguousarray(bands[:, k]) for k in range(BANDS)})
            if runs:
                names = ("doc_id", "tk", "start", "end", "x", "y")
                found = {name: np.concatenate(x) for name, x in zip(names, zip(*runs, strict=True), strict=True)}
                yield _batch(schema, found | {"kind": np.full(len(found["x"]), RUNS)})
            for held in (rows, sets, runs):
                held.clear()
            size = 0

        for batch in batches:
            for doc_id, tk, text in zip(batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                lines = text.split("\n")
                split = list(map(_words, lines))
                counts = list(map(len, split))
                if sum(counts) < min(x for x in (min_words, run_words) if x):
                    continue
                words = _hashed([w for line in split for w in line])
                size += len(words)
                for start, end, first, last in _paragraphs(lines, counts, min_words) if min_words else ():
                    rows.append((doc_id, tk, start, end, xxhash.xxh3_128_digest(words[first:last].tobytes())))
                    sets.append(shingles(words[first:last]))
                if run_words and len(words) >= run_words:
                    lo, n, h, c = anchors(words, run_words)
                    runs.append((np.full(len(lo), doc_id), np.full(len(lo), tk), lo, n, h, c))
                if size > 200_000:
                    yield from frames()
        yield from frames()

    return _texts(docs).mapInArrow(run, READ)


def _texts(docs: DataFrame) -> DataFrame:
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    return texts.where("doc_id is not null and text is not null")


def fetch(docs: DataFrame, asks: DataFrame, run_words: int) -> DataFrame:
    """A second pass, over the texts that ``asks(doc_id, tk, kind, start, end, id, least, most)`` name: the sorted shingle
    hashes of paragraphs, and the hash of each window of stretches (``FETCHED``).  One exchange of texts serves both."""
    schema = _schema(FETCHED)
    wanted = asks.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("kind", "start", "end", "id", "least", "most")).alias("asked"))
    holders = _texts(docs).join(wanted, ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"]).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, rows, size = [], [], [], 0
            for text, asked in zip(batch.column("text"), batch.column("asked"), strict=True):
                text, flat = text.as_py(), asked.values
                kind, start, end, key, least, most = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "start", "end", "id", "least", "most"))
                for a, b, i in zip(start[kind == PARAGRAPHS], end[kind == PARAGRAPHS], key[kind == PARAGRAPHS], strict=True):
                    ids.append(i)
                    sets.append(np.unique(shingles(_hashed(_words(text[a:b])))).tobytes())
                    size += len(sets[-1]) // 64
                at = kind == RUNS
                if at.any():
                    hashed, lo, n = Runs(_hashed(_words(text))), start[at], end[at].astype(np.int64)
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first = np.repeat(lo, n) + off
                    rows.append((np.repeat(key[at], n), off, hashed(first, first + run_words), np.repeat(least[at], n).astype(np.int64), np.repeat(most[at], n).astype(np.int64)))
                    size += len(off)
                if size > 100_000:
                    yield from _found(schema, ids, sets, rows)
                    ids, sets, rows, size = [], [], [], 0
            yield from _found(schema, ids, sets, rows)

    return holders.mapInArrow(run, FETCHED)


def _found(schema: pa.Schema, ids: list, sets: list, rows: list) -> Iterator[pa.RecordBatch]:
    if ids:
        yield _batch(schema, {"kind": np.full(len(ids), PARAGRAPHS), "id": ids, "set": sets})
    if rows:
        found = {name: np.concatenate(x) for name, x in zip(("id", "off", "w", "least", "most"), zip(*rows, strict=True), strict=True)}
        yield _batch(schema, found | {"kind": np.full(len(found["w"]), RUNS)})


def jaccard_column(a: str, b: str) -> Column:
    """Exact Jaccard similarity of the shingles of two paragraphs, from their sorted hashes."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return run(F.col(a), F.col(b))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with their similarity ``j``."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("j", jaccard_column("sa", "sb")).drop("sa", "sb")


def buckets(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of paragraphs: the distinct ones (``id, x, y, n, at, b0...``), the members of buckets that hold two or more of them
    (``band, key, id, n, size, most``), and where to fetch each member's text."""
    grouped = found.groupBy("x", "y").agg(
        F.count("*").alias("n"), F.min(F.xxhash64("doc_id", "tk", "start")).alias("at"), *(F.max(f"b{k}").alias(f"b{k}") for k in range(BANDS))
    )
    distinct = scratch.keep(grouped.withColumn("id", F.monotonically_increasing_id()), "distinct")
    bands = F.array(*(F.struct(F.lit(k).cast("int").alias("band"), F.col(f"b{k}").alias("key")) for k in range(BANDS)))
    posted = distinct.select("id", "n", F.explode(bands).alias("at")).select("at.band", "at.key", "id", "n")
    # Stored, so that the join below is one of two exchanges and a hot bucket's rows can be split.
    sizes = scratch.keep(posted.groupBy("band", "key").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1"), "buckets")
    met = scratch.keep(posted.join(sizes, ["band", "key"]), "members")
    wanted = distinct.join(met.select("id").distinct(), "id", "left_semi").select("id", "x", "y", "at")
    places = found.select("x", "y", F.xxhash64("doc_id", "tk", "start").alias("at"), "doc_id", "tk", "start", "end")
    return distinct, met, places.join(wanted, ["x", "y", "at"]).dropDuplicates(["id"]).select("doc_id", "tk", "start", "end", "id")


def links(met: DataFrame, sets: DataFrame, threshold: float, paired: int, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` between ids of distinct paragraphs that connect all colliding ones of ``threshold`` or more.

    Small buckets are compared pair by pair.  In a large one all members are
    compared with its commonest member; those that reach the threshold are
    connected through it, so only the others must still be compared: with each
    member whose distance from the commonest one differs by no more than the
    threshold allows, Jaccard distance being a metric.
    """
    small = met.where(F.col("size") <= paired).select("band", "key", "id")
    pairs = (
        small.withColumnRenamed("id", "a").join(small.withColumnRenamed("id", "b"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    )
    edges = similar(pairs, sets).where(F.col("j") >= threshold).select("a", "b")
    large = met.where(F.col("size") > paired)
    if not large.limit(1).count():
        return edges
    heads = scratch.keep(large.where("n = most").groupBy("band", "key").agg(F.min("id").alias("head")), "heads")
    rays = large.join(heads, ["band", "key"]).where("id <> head").select("band", "key", F.col("id").alias("b"), F.col("head").alias("a"))
    known = scratch.keep(similar(rays.select("a", "b").distinct(), sets), "rays")
    edges = edges.union(known.where(F.col("j") >= threshold).select("a", "b"))
    placed = scratch.keep(rays.join(known, ["a", "b"]).select("band", "key", F.col("b").alias("id"), "j"), "placed")
    rest = placed.where(F.col("j") < threshold)
    if not rest.limit(1).count():
        return edges
    sizes, postings = sized(placed.select("id").distinct(), sets, scratch)
    left = possible(placed, threshold, sizes, postings).distinct()
    return edges.union(similar(left, sets).where(F.col("j") >= threshold).select("a", "b"))


def sized(ids: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``id, size, rare``: how many shingles a set has, how many of them at most ``RARE`` of these sets have; and
    ``shingle, id`` of rare shingles that two sets or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shingle of a batch once: how many of its sets have it, and which, if they are few."""
        for batch in batches:
            found = [np.frombuffer(s.as_py(), dtype=np.int64) for s in batch.column("set")]
            if not found:
                continue
            flat, owners = np.concatenate(found), np.repeat(batch.column("id").to_numpy(), list(map(len, found)))
            order = np.argsort(flat, kind="stable")
            flat, owners = flat[order], owners[order]
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            counts = np.diff(np.append(starts, len(flat)))
            few = counts <= RARE
            offsets = np.concatenate([[0], np.cumsum(np.where(few, counts, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(owners[np.repeat(few, counts)]))
            yield pa.RecordBatch.from_arrays([pa.array(flat[starts]), pa.array(counts), lists], names=["shingle", "n", "ids"])

    mine = ids.join(sets, "id").repartition("id")
    every = scratch.keep(mine.mapInArrow(run, "shingle long, n long, ids array<long>"), "shingles")
    known = every.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") <= RARE)
    rare = scratch.keep(every.select("shingle", "ids").join(known, "shingle").select("shingle", F.explode("ids").alias("id"), "n"), "rare")
    counts = rare.groupBy("id").agg(F.count("*").alias("rare"))
    sizes = mine.select("id", (F.length("set") / 8).cast("long").alias("size")).join(counts, "id", "left").select("id", "size", F.coalesce("rare", F.lit(0)).alias("rare"))
    return scratch.keep(sizes, "sizes"), rare.where("n > 1").select("shingle", "id")


def possible(placed: DataFrame, threshold: float, sizes: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs of a member that is too far from its bucket's commonest one with any member it may yet be close to.

    Two sets that share ``s`` of their rare shingles share at most those and
    what is not rare, which bounds their similarity.  Pairs with a rare shingle
    in common meet at it, at most ``RARE`` sets at each, and are tallied.
    Pairs without meet in their bucket; there a member is sent only to the
    sizes (in steps of 2 %) that the bound allows it.  Edited copies mostly
    have more rare shingles than the bound allows, so what meets does not grow
    with the square of a bucket.
    """
    known = placed.join(sizes, "id").withColumn("level", F.floor(F.log("size") * 50))
    far = known.where(F.col("j") < threshold)
    enough = lambda shared: shared * (1 + threshold) >= threshold * (F.col("sa") + F.col("sb")) - 1e-6
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")

    side = lambda df, x: df.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), (F.col("size") - F.col("rare")).alias(f"o{x}"))
    left = postings.join(far.select("id").distinct(), "id", "left_semi").select("shingle", F.col("id").alias("a"))
    tallied = left.join(postings.select("shingle", F.col("id").alias("b")), "shingle").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("s"))
    met = tallied.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    met = met.where(enough(F.least(F.col("oa") + F.col("s"), F.col("ob") + F.col("s")))).select(*ends)

    o = F.col("size") - F.col("rare")
    low = F.floor(F.log(F.col("size") * threshold) * 50 - 1e-6)
    # o / (size + other - o) >= threshold bounds the other's size.
    most = o * ((1 + threshold) / threshold) - F.col("size")
    high = F.floor(F.log(F.greatest(most, F.lit(1.0))) * 50 + 1e-6)
    rest = far.where((most >= F.col("size") * threshold) & (high >= low))
    rest = rest.select("band", "key", F.col("id").alias("a"), F.col("j").alias("ja"), F.col("size").alias("sa"), o.alias("oa"), F.explode(F.sequence(low, high)).alias("level"))
    other = known.select("band", "key", "level", F.col("id").alias("b"), F.col("j").alias("jb"), F.col("size").alias("sb"), o.alias("ob"))
    apart = (
        rest.join(other, ["band", "key", "level"])
        .where((F.col("a") != F.col("b")) & (F.abs(F.col("ja") - F.col("jb")) <= 1 - threshold + 1e-9))
        .where((F.col("jb") >= threshold) | (F.col("a") < F.col("b")))
        .where(enough(F.least("oa", "ob")))
        .select(*ends)
    )
    return met.union(apart)


def _shared(found: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Paragraphs of ``found`` that have near-duplicates, see :func:`shared_passages`."""
    joined = components(edges)
    classes = distinct.select("x", "y", "n", "id").join(joined.df.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.where("component is not null or n > 1").select("x", "y", F.coalesce("component", "id").alias("component"))
    shared = Stored(found.select("doc_id", "tk", "start", "end", "x", "y").join(classes, ["x", "y"]).drop("x", "y"), "shared").df
    joined.discard()
    firsts = Stored(shared.groupBy("component").agg(F.min(F.struct("doc_id", "tk", "start")).alias("first")), "firsts").df
    here = F.struct("doc_id", "tk", "start") == F.col("first")
    return shared.join(firsts, "component").select("doc_id", "tk", "start", "end", "component", F.col("first.doc_id").alias("kept_in"), here.alias("keep"))


def shared_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, paired: int = PAIRED) -> DataFrame:
    """Paragraphs that have near-duplicates: ``doc_id, tk, start, end, component, kept_in, keep``.

    A paragraph is a line of ``min_words`` words or more, or shorter lines in a
    row, up to a blank one, of so many together.  A component holds paragraphs
    connected by 5-word-shingle Jaccard of ``threshold`` or more.  Its first one
    by ``(doc_id, tk, start)`` is kept (``keep`` true, and of rows that repeat a
    document all); ``kept_in`` is that document; ``tk`` is the hash of the text
    that the place is in.  Null and short texts have no paragraphs.
    """
    scratch = Scratch()
    found = scratch.keep(read_texts(docs, min_words, None), "read", "zstd")
    distinct, met, places = buckets(found, scratch)
    fetched = scratch.keep(fetch(docs, _asks(places, None), RUN_WORDS), "fetched", "zstd")
    out = _shared(found, distinct, links(met, fetched.select("id", "set"), threshold, paired, scratch))
    scratch.clear()
    return out


def _asks(places: DataFrame | None, windows: DataFrame | None) -> DataFrame:
    """What to fetch from texts, of paragraphs, of stretches or of both."""
    names = ("doc_id", "tk", "kind", "start", "end", "id", "least", "most")
    none = F.lit(0).cast("long")
    parts = [places.withColumns({"kind": F.lit(PARAGRAPHS), "least": none, "most": none}).select(*names)] if places is not None else []
    parts += [windows.withColumn("kind", F.lit(RUNS)).select(*names)] if windows is not None else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Runs of ``run_words`` words or more that two or more documents have, see :func:`repeats.runs_of`."""
    scratch = Scratch()
    found = scratch.keep(read_texts(docs, None, run_words), "read", "zstd")
    placed, classes, several, windows = stretches(found, scratch)
    fetched = scratch.keep(fetch(docs, _asks(None, windows), run_words), "fetched")
    out = Stored(runs_of(placed, classes, several, fetched, scratch), "runs").df
    scratch.clear()
    return out


def by_document(shared: DataFrame) -> DataFrame:
    """One row for each text with shared passages; ``cuts`` are the places to remove, in order."""
    cut = F.struct("start", "end", "kept_in")
    return shared.groupBy("doc_id", "tk").agg(
        F.array_distinct(F.array_sort(F.collect_list(F.when(~F.col("keep"), cut)))).alias("cuts"),
        F.collect_set(F.struct("start", "end")).alias("places"),
        F.min("kept_in").alias("class_id"),
    )


def dedup_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, paired: int = PAIRED, run_words: int | None = None) -> DataFrame:
    """``docs`` with near-duplicate paragraphs cut out of ``text`` except for the first of each component.

    With ``run_words``, so are all runs of that many words or more, inside
    lines or over several, that a document of a smaller id has word for word.

    All rows and columns stay; ``cuts`` (places with the document that has them
    first), ``n_shared`` and ``class_id`` (the smallest document that any of
    them is in) come new and replace columns of these names.  Null texts stay
    null, empty tables empty; rows of one ``doc_id`` with different texts are
    looked at by themselves; a null ``doc_id`` is never cut.
    """
    docs = docs.drop("cuts", "n_shared", "class_id")
    scratch = Scratch()
    found = scratch.keep(read_texts(docs, min_words, run_words), "read", "zstd")
    lines = found.where(F.col("kind") == PARAGRAPHS)
    distinct, met, places = buckets(lines, scratch)
    windows = None
    if run_words:
        placed, classes, several, windows = stretches(found.where(F.col("kind") == RUNS), scratch)
    fetched = scratch.keep(fetch(docs, _asks(places, windows), run_words or RUN_WORDS), "fetched", "zstd")
    sets = fetched.where(F.col("kind") == PARAGRAPHS).select("id", "set")
    every = by_document(_shared(lines, distinct, links(met, sets, threshold, paired, scratch)))
    if run_words:
        runs = runs_of(placed, classes, several, fetched.where(F.col("kind") == RUNS), scratch)
        every = every.join(runs, ["doc_id", "tk"], "full").withColumn("class_id", F.least("class_id", F.array_min(F.transform("runs", lambda r: r["least"]))))
    else:
        every = every.withColumn("runs", F.lit(None).cast("array<struct<lo:int,hi:int,least:long,most:long>>"))
    every = Stored(every.select("doc_id", "tk", F.struct("cuts", "places", "runs", "class_id").alias("found_")), "passages").df
    scratch.clear()
    own, key = [F.col(f"own_.{c}") for c in docs.columns], [F.col("own_.doc_id").cast("long") == F.col("doc_id"), F.xxhash64("own_.text") == F.col("tk")]
    out = docs.select(F.struct(*docs.columns).alias("own_")).join(every, key, "left")
    made = cut_column(F.col("own_.doc_id"), F.col("own_.text"), F.col("found_.cuts"), F.col("found_.places"), F.col("found_.runs"), run_words or RUN_WORDS)
    out = out.withColumn("made_", made)
    text = F.when(F.size("made_.cuts") > 0, F.col("made_.text")).otherwise(F.col("own_.text")).alias("text")
    own = [text if c == "text" else x for c, x in zip(docs.columns, own, strict=True)]
    return out.select(*own, F.col("made_.cuts").alias("cuts"), F.col("made_.n_shared").alias("n_shared"), F.col("found_.class_id").alias("class_id"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: passages it shares, places cut, the documents that keep them, and the text left."""
    out = dedup_passages(documents(spark, sf_dir), run_words=RUN_WORDS)
    spans = F.array_join(F.transform("cuts", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",")
    return out.select(
        "doc_id",
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.greatest(F.coalesce(F.size("cuts"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.lit("")).alias("removed"),
        F.coalesce(F.array_distinct(F.transform("cuts", lambda c: c["kept_in"])), F.expr("cast(array() as array<bigint>)")).alias("kept_in"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
