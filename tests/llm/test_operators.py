"""Each text operator against a plain version of it, and on awkward rows."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, common, doc_simhash, maxent, mips, near_simhash, packing, para_dedup, pii, registry, toxicity

from ..conftest import DATA

AWKWARD = [
    (1, None, "x"), (2, "", "x"), (3, "   \n\t ", "x"), (4, "same text here for two", "x"), (5, "same text here for two", "y"),
    (6, "word " * 30_000, "z"), (7, "x" * 60_000, "z"), (7, "x" * 60_000, "z"), (None, "no id", "z"), (8, "<|endoftext|> Éé ß 日本語 🤣 a\x00b  c \n \n", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank, equal, very long and repeated rows, and columns whose names operators use."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("fp", "component", "ids", "start", "end", "score_", "held", "n", "word", "rid", "set", "size")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, DATA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# --- 1: encoding -----------------------------------------------------------------------------------------------------


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_file(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(texts):
    t, e = library("byte_bpe_50k.json"), bpe.TrieEncoder("byte_bpe_50k.json")
    random.seed(1)
    odd = ["".join(random.choice("aé ß\n\t'ts 12²!<|endof>日  ") for _ in range(200)) for _ in range(200)]
    every = [*texts.values(), *(r[1] or "" for r in AWKWARD), "<|endoftext|>", "a<|endoftext|>b", *odd]
    for said, ids in zip(every, e.encode(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(said, add_special_tokens=False).ids
        assert e.decode(ids) == said


def test_small_caches_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    few = list(texts.values())[:30]
    assert bpe.TrieEncoder("byte_bpe_50k.json").encode(few) == bpe.encoder("byte_bpe_50k.json").encode(few)


def test_encoding_rows(awkward, empty):
    rows = bpe.bpe_round_trip(awkward).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in rows) == sorted((i or 0, t or "") for i, t, _ in AWKWARD)
    assert bpe.bpe_round_trip(empty).count() == 0


# --- 2: toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_keeps_labels_out(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic")
    out = toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id").toPandas()
    assert ((out["score"] >= 0.5).astype(int) == out["predicted"]).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_toxicity(docs, turned).select("doc_id", F.col("score").alias("again")).toPandas()
    assert np.allclose(out.merge(again)["score"], out.merge(again)["again"])


def test_restoring(docs):
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))
    plain = "the idiot and a loser"
    assert r.text(plain) == plain
    assert r.text("L0SER, loooser! i d i o t") == "loser loser idiot"
    assert r.text("de la ç y a") == "de la ç y a"


def readings(lattice):
    """All paths of a lattice, with their channel cost."""
    for path in itertools.product(*lattice):
        yield "".join(letters for letters, _ in path), sum(cost for _, cost in path)


def test_decoding_equals_all_paths(docs):
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))
    random.seed(14)
    for _ in range(150):
        token = "".join(random.choice("aeiost0134@$!|.-ll") for _ in range(random.randint(1, 8)))
        best = max(r.score(said) + cost for said, cost in readings(r.lattice(token)))
        got = r.decode(token)
        assert max(r.score(said) + cost for said, cost in readings(r.lattice(token)) if said == got) == pytest.approx(best)


def test_long_obfuscated_words(docs):
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))
    assert r.text("1d10t" + "t" * 60) == r.text("1d10ttt") and r.text("L0SER" + "!" * 70) == "loser"
    assert r.text(".".join("idiotidiotidiotidiotidiotidiot")) == "idiot" * 6
    for long in ("x" * 60_000, "a" + "." * 30_000 + "a", "a1" * 5_000, "!" * 40_000):
        assert isinstance(r.text(long), str)


def test_held_out_rows_beat_any_constant(spark):
    """Of held-out rows the mean of the shares of toxic and of clean ones told right; a constant gets a half."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    marked = labels.select("doc_id", "toxic").where("toxic is not null")
    held = docs.join(marked.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.score_toxicity(held.withColumn("toxic", F.lit(1)), marked).where("held_out").select("doc_id", "predicted").join(marked, "doc_id").toPandas()
    told = (out["predicted"] == out["toxic"]).groupby(out["toxic"]).mean()
    assert len(told) == 2 and told.mean() > 0.8


def test_toxicity_rows(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(awkward, none).collect()
    assert len(out) == len(AWKWARD) and {r["score"] for r in out} == {0.0}
    one = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(awkward, one).count() == len(AWKWARD)
    assert toxicity.score_toxicity(empty, one).count() == 0


# --- 3: personal data ------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark, texts):
    random.seed(3)
    pieces = ["a@b.co", "1.2.3.4", "+1 (736) 555-2678", "4111111111111111", "4111-1111-1111-1111", "..", "-", " ", "@", "+", "5", "300.1.1.1", "_x%", "é", "0000.1.2.3", "a.b@c-d.e.f", "12 34", "\n", "+(", "1.2.3.4.5.6.7.8"]
    made = ["".join(random.choice(pieces) for _ in range(12)) for _ in range(600)]
    every = [*texts.values(), *made, "9" * 20_000, "1 " * 9_000, "a" * 30_000 + "@", "1." * 5_000]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["rank"] - 1, s["end"], s["kind"]) for s in r["spans"] if s["base"]] for r in pii.find_pii(df, keep_text=False).collect()}
    for i, text in enumerate(every):
        assert got[i] == base_spans(text), text[:200]


def test_additions_and_redaction(spark):
    said = "Mail joe (at) site (dot) org or call (736) 555-2678, card 4111.1111.1111.1111, a@b.co."
    df = spark.createDataFrame([(1, said), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_pii(df).withColumn("clean", pii.redacted("text", "spans")).collect()}
    assert out[1]["clean"] == "Mail [EMAIL] or call [PHONE], card [CARD], [EMAIL]."
    assert out[2]["spans"] == []


def test_reliabilities_are_ordered():
    counts = [((1, 1, 1, 1), 90), ((-1, 1, 1, 1), 5), ((1, -1, 0, -1), 5), ((-1, -1, -1, -1), 60)]
    belief, table = pii.reliabilities(counts)
    assert belief[1, 1, 1, 1] > 0.9 > 0.1 > belief[-1, -1, -1, -1]
    assert all(table[k, 1][1] > table[k, 0][1] for k in range(4))
    assert pii.span_classifier({})["email"][0] == 0.0


def test_estimated_reliabilities_beat_the_majority():
    r = random.Random(4)
    told = []
    for _ in range(4000):
        truth = r.random() < 0.5
        told.append((truth, tuple(((1 if (r.random() < right) == truth else -1) if r.random() < votes else 0) for right, votes in ((0.95, 0.9), (0.7, 0.6), (0.6, 0.5), (0.85, 1.0)))))
    belief, _ = pii.reliabilities(sorted(Counter(v for _, v in told).items()))
    share = lambda guess: sum(guess(v) == truth for truth, v in told) / len(told)
    assert share(lambda v: belief[v] >= 0.5) > share(lambda v: sum(v) > 0) + 0.02


def test_labelers_decide_what_is_added(spark, docs):
    """Of made texts: keys after telling words and written-out forms are added; numbers that fail the check, overlong
    address parts and plain hashes beside words against them are not."""
    key = hashlib.sha1
    rows = [(i, f"Call +1 (736) 555-{1000 + i}, card 4111 1111 1111 1111, a{i}@b.com, 10.1.2.{i}; token = \"{key(b'%d' % i).hexdigest()}\"") for i in range(40)]
    rows += [(100 + i, f"order {4111111111111112 + 10 * i}, 300.1.2.{i}, commit {key(b'x%d' % i).hexdigest()}") for i in range(40)]
    rows += [(200, "write joe (at) site (dot) org")]
    out = {r["doc_id"]: {(s["kind"], s["base"]) for s in r["spans"]} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()}
    assert all(out[i] == {("phone", True), ("card", True), ("email", True), ("ip", True), ("secret", False)} for i in range(40))
    assert all(out[100 + i] <= {("card", True)} for i in range(40)) and sum(not out[100 + i] for i in range(40)) > 30 and out[200] == {("email", False)}
    found = pii.find_pii(common.documents(spark, "/root/testdata/sf0.01")).select("text", F.explode("spans").alias("s")).where("not s.base").collect()
    assert found and all(re.search("token", r["text"][max(0, r["s"]["start"] - 24) : r["s"]["start"]]) for r in found if r["s"]["kind"] == "secret")


def test_personal_data_rows(awkward, empty):
    assert pii.find_pii(awkward).count() == len(AWKWARD)
    assert pii.find_pii(empty).count() == 0
    plan = pii.find_pii(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4: near duplicates ----------------------------------------------------------------------------------------------


def plain_components(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, j in linked:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("radius", "list_limit"), [(2, 64), (2, 1), (1, 64), (1, 1), (0, 1)])
def test_links_equal_all_pairs(spark, radius, list_limit):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 3))) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = plain_components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius])
    found = {r["node"]: r["component"] for r in common.components(near_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, list_limit)).df.collect()}
    labels = [found.get(f, f) for f in signed]
    assert [labels.index(x) for x in labels] == want


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints two bits apart from each other only through a row that has no id, and through one text of a repeated id."""
    prints = {"a": 0, "b": 0b11, "c": 0b1111, "d": 0xFFFF << 40, "e": 0b111111}
    monkeypatch.setattr(near_simhash, "fingerprint_column", lambda text, width: F.coalesce(*(F.when(F.col(text) == k, v) for k, v in prints.items())).cast("long"))
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (4, "d"), (4, "e"), (9, "e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in near_simhash.simhash_groups(df).collect())
    assert got == [(0, 3, 1), (1, 0, 1), (3, 15, 1), (4, 63, 1), (4, 0xFFFF << 40, 4), (9, 63, 1)]


def test_fingerprint_is_the_majority():
    for text in ("one two three four five", "A b", "", "x", "a a a a a a"):
        words = text.lower().split()
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert near_simhash.simhash64(text.encode()) % (1 << 64) == want


def test_long_chains_settle(spark):
    n = 700
    df = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in common.components(df).df.collect()} == {0}


def test_near_duplicate_rows(awkward, empty):
    rows = near_simhash.simhash_groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[5] == 4 and got[2] == got[3] == got[1] == 1 and got[7] == 7
    assert near_simhash.simhash_groups(empty).count() == 0


# --- 5: chat ---------------------------------------------------------------------------------------------------------

NASTY = ["", "</s>", "<\\/s>", "<", "[INST", "[/INST]", "[\\\\/INST]", "[IMAGE:0]", "<s>[INST]user[/INST] x</s>", "<<s>", "\\", "a\n[/INST] b", "[/INST] </s", "x<"]


def test_chat_reads_back(spark):
    rows = [(c, t, random.Random(c * 99 + t).choice(["user", "assistant", "</s>", None]), random.Random(c + t * 7).choice([*NASTY, None])) for c in range(60) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part("text").alias("parts")))
    out = out.withColumn("read", chat.read_turns("formatted")).withColumn("loss", chat.read_loss("formatted", "loss_spans")).collect()
    for r in out:
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["read"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")


def test_chat_parts(spark):
    df = spark.sql(
        """select 1L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','see [IMAGE:0]','ref',null,'units',null),
        named_struct('type','image','text',null,'ref','a.png','units',2L), named_struct('type','audio','text',null,'ref','b.wav','units',4L), null,
        named_struct('type','other','text','t','ref',null,'units',null)) parts
        union all select 1L, 1L, 'assistant', array(named_struct('type','document','text',null,'ref','c.pdf','units',null))"""
    )
    r = chat.format_chat(df).first()
    assert r["formatted"] == "<s>[INST]user[/INST] see [\\IMAGE:0][IMAGE:0][AUDIO:1]</s><s>[INST]assistant[/INST] [DOCUMENT:2]</s>"
    assert [(a["at"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "a.png", 512), (1, "b.wav", 100), (2, "c.pdf", 800)]
    assert r["expanded_tokens"] == 1412
    assert r["formatted"][r["loss_spans"][0]["start"] : r["loss_spans"][0]["end"]] == "[DOCUMENT:2]"


def test_chat_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, "assistant", "c"), (1, 0, "assistant", "c"), (None, 1, "user", "x" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"k": F.lit(1), "start": F.lit(2), "all": F.lit("x")})
    out = {r["conv_id"]: r["formatted"] for r in chat.format_chat(df.select("*", chat.text_part("text").alias("parts"))).collect()}
    assert out[1] == "<s>[INST]user[/INST] b</s>" + "<s>[INST]assistant[/INST] c</s>" * 2 and len(out[None]) > 50_000
    assert chat.format_chat(df.where("false").select("*", chat.text_part("text").alias("parts"))).count() == 0


# --- 6: top-k --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [8192, 7])
def test_top_k_equals_all_products(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 9)) * rng.lognormal(size=(400, 1))
    x[50:60] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, []), (905, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"len": F.lit(1), "label": F.lit(2)})
    use = mips.usable(df)
    got = mips.top_k(use, use.where("vec_id % 5 = 0"), 10, block).collect()
    known = {i: [int(np.floor(1024 * c)) for c in v] + [0] * (9 - len(v)) for i, v in rows if i < 900 or i in (904, 905)}
    for q in (i for i in known if i % 5 == 0):
        best = sorted(((sum(a * b for a, b in zip(known[q], v, strict=True)), -i) for i, v in known.items() if i != q), reverse=True)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(i, s) for _, i, s in mine] == [(-i, s) for s, i in best]


def test_pruning_skips_most():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(20_000, 64)) @ np.diag(np.geomspace(3, 0.01, 64)) * 300).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    state = mips.Pruned(np.arange(8), x[:8], mips.fit_rotation(x[:2000]), np.full(8, -(1 << 62)), 10)
    for at in range(0, len(x), 512):
        state.look(np.arange(at, min(at + 512, len(x))), x[at : at + 512])
    assert state.computed < state.seen * 0.6


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    use = mips.usable(df)
    assert mips.top_k(use, use).count() == 2
    assert mips.top_k(use, use.where("false")).count() == 0
    assert mips.top_k(use.where("false"), use.where("false")).count() == 0


# --- 7: packing ------------------------------------------------------------------------------------------------------


def test_best_fit_equals_a_plain_search():
    random.seed(8)
    for _ in range(150):
        window = random.choice([7, 16, 31, 100, 2048])
        lengths = [random.randint(1, window) for _ in range(random.randint(0, 120))]
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else window) - n)
        to, at, count = packing.best_fit_decreasing(lengths, window)
        used: dict[int, int] = {}
        for k, o, n in sorted(zip(to, at, lengths, strict=True)):
            assert used.get(k, 0) == o
            used[k] = o + n
        assert count == len(free) and sorted(window - u for u in used.values()) == sorted(free)


def test_words_equal_the_library(texts):
    t, mine = library("word_bpe_49k.json"), packing.WordTokenizer("word_bpe_49k.json")
    odd = ["A <|ENDOFTEXT|> <|endoftext|>b É. É., a,. 5. x² ². İ. É́. ΣΑΣ", "a ̈b e ́ ﬁ ᄒ", "don't 'S DON'T", *(r[1] or "" for r in AWKWARD)]
    for said in [*texts.values(), *odd]:
        assert np.frombuffer(mine.encode(said.encode()), "<u4").tolist() == t.encode(said, add_special_tokens=False).ids, said[:80]
    words = [w for w in json.load(open(bpe.vocabulary_file("word_bpe_49k.json")))["model"]["vocab"] if w.endswith("</w>")]
    plain = [w.removesuffix("</w>").encode() for w in words if packing.PLAIN.fullmatch(w.removesuffix("</w>").encode())]
    assert mine.merger.ids_of(plain) == mine.ids_of([w.decode() for w in plain])


@pytest.mark.parametrize("held", [12_000_000, 5_000])
def test_pieces_cover_every_token_once(docs, texts, held, monkeypatch):
    t = library("word_bpe_49k.json")
    batches = [docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).toArrow().combine_chunks().to_batches()[0]]
    monkeypatch.setattr(packing, "HELD_TOKENS", held)
    rows = [r for b in packing.packed(packing.tokenized(iter(batches), "word_bpe_49k.json", 1), 2048, 0) for r in b.to_pylist()]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = b"".join(r["ids"] for r in sorted(by_doc[i], key=lambda r: r["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]
    filled = 0
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        filled += at
    assert filled / (2048 * len(by_sequence)) > (0.97 if held > 1e6 else 0.8)


def test_packing_rows(awkward, empty):
    out = packing.pack_documents(awkward).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 1 and sum(1 for r in out if r["doc_id"] is None) == 1
    assert packing.pack_documents(empty).count() == 0


def test_padding_does_not_depend_on_partitions(spark):
    """Over 211 partitions windows are filled within a point of what one partition gives, and hold every token once."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    fill, tokens = {}, {}
    for n in (1, 211):
        rows = packing.digest(packing.pack_documents(docs.repartition(n))).toPandas()
        whole = rows.sort_values("offset").groupby("sequence_id")
        for _, part in whole:
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 2048
        fill[n], tokens[n] = rows["length"].sum() / (2048 * rows["sequence_id"].nunique()), rows["length"].sum()
    assert tokens[1] == tokens[211] and fill[1] - fill[211] < 0.01


# --- 8: language model -----------------------------------------------------------------------------------------------


def test_scores(spark, docs, texts):
    for limit in (150_000, 100):
        rows = {r["doc_id"]: r for r in maxent.score_texts(docs, head_limit=limit).collect()}
        words = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
        counts: dict = {}
        for i, w in words.items():
            if zlib.crc32(str(i).encode()) % 10:
                for x in w:
                    counts[x] = counts.get(x, 0) + 1
        n, v = sum(counts.values()), len(counts)
        for i, w in words.items():
            want = sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert rows[i]["base_score"] == pytest.approx(want) and rows[i]["n_tokens"] == len(w)
            assert rows[i]["n_known"] == sum(x in counts for x in w) and rows[i]["train_tokens"] == n
        held = [r for r in rows.values() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(9)
    w = rng.normal(size=(3 * maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    at = maxent.contexts(rng.integers(0, 4096, 50), np.array([0, 10, 11, 49]))
    assert np.allclose(np.exp(maxent.class_logits(w, at)).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(np.exp(maxent.class_logits(w * 1000, at)).sum(axis=1), 1, atol=1e-3)
    assert (at[[0, 10, 11, 49], 0] == 0).all() and (at[1, 1] == maxent.BUCKETS) and (at[12, 1] == maxent.BUCKETS)


def test_run_sums():
    rng = np.random.default_rng(12)
    rows, starts = rng.normal(size=(500, 3)), np.array([0, 1, 2, 5, 90, 91, 300, 499])
    assert np.allclose(maxent.run_sums(rows, starts), np.add.reduceat(rows, starts, axis=0))


def test_score_rows(awkward, empty):
    rows = maxent.score_texts(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(np.isfinite(r["score"]) for r in rows)
    assert maxent.score_texts(empty).count() == 0
    assert maxent.score_texts(awkward, F.lit(True)).select("n_known", "train_tokens").distinct().collect() == [(0, 0)]


# --- 9: fingerprints -------------------------------------------------------------------------------------------------


def test_edited_fingerprints(spark, docs, texts):
    rows = {r["doc_id"]: r for r in doc_simhash.edited_fingerprints(docs.repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[following][:third]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(texts[i])
        assert rows[i]["fingerprint"] == doc_simhash.weighted_simhash(texts[i]).hex()
        assert rows[i]["near_next"] == doc_simhash.likeness(bytes.fromhex(rows[i]["fingerprint"]), bytes.fromhex(rows[following]["fingerprint"]))
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.9


def test_radius_search_equals_all_pairs(spark):
    random.seed(10)
    base = [random.getrandbits(128) for _ in range(6)]
    fps = sorted({f"{b ^ sum(1 << k for k in random.sample(range(128), random.randint(0, 4))):032x}" for b in base for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in [*fps, *fps[:3]]], "fp string")
    got = {(r["fp"], r["near"]): r["distance"] for r in doc_simhash.within_radius(df, df, 3).collect()}
    want = {(a, b): d for a, b in itertools.permutations(fps, 2) if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want


def test_neighbours_of_asked_rows(spark, docs, texts):
    rows = {r["doc_id"]: r for r in doc_simhash.op9_weighted_simhash(spark, DATA).collect()}
    prints = {r["fingerprint"] for r in rows.values()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        near = sum(0 < (int(f, 16) ^ int(r["fingerprint"], 16)).bit_count() <= 3 for f in prints)
        assert r["n_near"] == (near if i % 20 == 0 else None)


def test_fingerprint_rows(awkward, empty):
    assert len(doc_simhash.edited_fingerprints(awkward).collect()) == len(AWKWARD)
    one = awkward.where("doc_id = 4")
    assert doc_simhash.edited_fingerprints(one).first()["near_next"] == 1.0
    assert doc_simhash.edited_fingerprints(empty).count() == 0


# --- 10: passages ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def passages(spark):
    """Passages with edits of several sizes, some of them in families, in documents of their own lines."""
    r = random.Random(11)
    rows, doc = [], 0
    for _ in range(8):
        base = [f"w{r.randint(0, 5000)}" for _ in range(70)]
        for _ in range(14):
            said = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                said[r.randrange(70)] = f"e{r.randint(0, 3000)}"
            if r.random() < 0.2:
                base = said
            rows.append((doc, " ".join([f"own{doc}x{k}" for k in range(45)]) + "\n" + " ".join(said) + "\nshort line"))
            doc += 1
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("paired", [1, 24])
def test_passages_equal_all_pairs(passages, paired):
    df, rows = passages
    lines = []
    for i, text in rows:
        at = 0
        for line in text.split("\n"):
            words = line.split()
            if len(words) >= 40:
                lines.append((i, at, at + len(line), {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
            at += len(line) + 1
    close = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(lines[i][3] & lines[j][3]) >= 0.8 * len(lines[i][3] | lines[j][3])]
    want = {lines[i][:3] for i, c in enumerate(plain_components(len(lines), close)) if c != i}
    got = {(r["doc_id"], r["start"], r["end"]) for r in para_dedup.shared_passages(df, paired=paired).where("not keep").collect()}
    assert got == want and want


def test_cuts(passages, awkward, empty):
    df, rows = passages
    out = {r["doc_id"]: r for r in para_dedup.dedup_passages(df).collect()}
    for i, text in rows:
        kept = [line for line in text.split("\n")]
        gone = [text[c["start"] : c["end"]] for c in out[i]["cuts"] or []]
        assert out[i]["text"].split("\n") == [line for line in kept if line not in gone]
    assert para_dedup.dedup_passages(awkward).count() == len(AWKWARD)
    assert para_dedup.dedup_passages(empty).count() == 0


# --- together --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "packing"]
    docs = common.table(spark, DATA, "documents")
    kept = common.Stored(corpus_pipeline.drop_toxic(spark, docs, DATA), "t").df
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, DATA, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and sum(labels[i] for i in ids if i in labels) <= 1
    one = common.Stored(corpus_pipeline.one_of_each_group(spark, kept, DATA), "o").df
    want = {r["component_id"] for r in near_simhash.simhash_groups(kept).collect()}
    assert {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    cut = common.Stored(corpus_pipeline.cut_passages(spark, one, DATA), "c").df
    assert para_dedup.shared_passages(cut).where("not keep").count() == 0
    clean = common.Stored(corpus_pipeline.redact_personal_data(spark, cut, DATA), "r").df
    assert all(not base_spans(r["text"]) for r in clean.collect()) and clean.count() == cut.count()
    packed = corpus_pipeline.pack(spark, clean, DATA)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == clean.count()
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        common.table(spark, DATA, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_has_its_columns(spark):
    for name in ("op1_bpe_round_trip", "op3_weak_pii", "op4_simhash_near_dedup", "op7_best_fit_packing", "op9_weighted_simhash", "op10_passage_dedup"):
        assert registry.queries()[name](spark, DATA).columns
    assert set(registry.oracle_sql()) <= set(registry.queries())
