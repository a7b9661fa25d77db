"""Repeated runs of words against brute force over whole texts."""

import random

from pyspark.sql import functions as F

from tallyloom.llm import para_dedup, repeats

RUN = repeats.RUN_WORDS


def broken(words, r, most):
    """Words in lines of random lengths, up to ``most`` words."""
    out, at = [], 0
    while at < len(words):
        n = r.randint(1, most)
        out.append(" ".join(words[at : at + n]))
        at += n
    return "\n".join(out)


def texts():
    """Passages of 45 to 120 words, whole or in part, inside long lines or over short ones, and texts of one word."""
    r = random.Random(5)
    passages = [[f"p{k}x{r.randint(0, 400)}" for _ in range(r.randint(45, 120))] for k in range(12)]
    rows = [(200, "again " * 130), (201, "again " * 90), (202, None), (203, " \n"), (204, "few words"), (None, " ".join(passages[0]))]
    for doc in range(80):
        words = [f"own{doc}x{k}" for k in range(r.randint(0, 60))]
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            a, b = r.choice([(0, 0), (0, 0), (r.randint(0, 20), 0), (0, r.randint(0, 20))])
            words += p[a : len(p) - b] + [f"gap{doc}x{k}" for k in range(r.randint(0, 30))]
        rows.append((doc, broken(words, r, r.choice([12, 500]))))
    return rows


def plain(rows):
    """For each document the places of words that a window of an earlier document covers."""
    split = {i: t.lower().split() for i, t in rows if i is not None and t is not None}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - RUN + 1):
            first.setdefault(tuple(split[i][k : k + RUN]), i)
    return {i: {j for k in range(len(w) - RUN + 1) if first[tuple(w[k : k + RUN])] < i for j in range(k, k + RUN)} for i, w in split.items()}


def test_runs_equal_brute_force(spark):
    rows = texts()
    found = {r["doc_id"]: r["runs"] for r in para_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, want in plain(rows).items():
        assert {j for r in found.get(i, []) if r["least"] < i for j in range(r["lo"], r["hi"] + RUN)} == want
    assert any(plain(rows).values()) and all(r["least"] < r["most"] for runs in found.values() for r in runs)


def test_passages_inside_and_over_lines_are_cut(spark):
    """Whatever repeats word for word goes, nothing else but lines that are near copies."""
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {r["doc_id"]: r["cuts"] or [] for r in para_dedup.dedup_passages(df).collect()}
    out = {r["doc_id"]: r for r in para_dedup.dedup_passages(df, run_words=RUN).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        if i is None or text is None:
            assert out[i]["text"] == text and not out[i]["cuts"]
            continue
        gone = plain(rows)[i]
        places = [m.span() for m in repeats._WORD.finditer(text)]
        in_lines = {j for j, (a, b) in enumerate(places) if any(c["start"] <= a and b <= c["end"] for c in lines[i])}
        assert out[i]["text"].split() == [w for j, w in enumerate(text.split()) if j not in gone | in_lines]
        cuts = out[i]["cuts"] or []
        assert all(a["end"] <= b["start"] for a, b in zip(cuts, cuts[1:], strict=False)) and all(c["kept_in"] <= i for c in cuts)
        assert (out[i]["n_shared"] or 0) >= bool(cuts)


def test_first_documents_count_what_they_share(spark):
    said = " ".join(f"s{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"a b {said} c"), (2, f"d\n{said} e\nf"), (3, f"g {said}\nh"), (4, "none")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in para_dedup.dedup_passages(df.withColumn("n", F.lit(1)), threshold=1.01, run_words=RUN).collect()}
    assert [rows[i]["n_shared"] for i in (1, 2, 3, 4)] == [1, 1, 1, None] and [rows[i]["class_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, None]
    assert [rows[i]["text"] for i in (1, 2, 3, 4)] == [f"a b {said} c", "d\ne\nf", "g\nh", "none"]


def test_passages_in_lines_of_any_length(spark):
    """A passage alone on a line, inside longer lines and over short lines is one passage."""
    said = [f"s{k}" for k in range(60)]
    own = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    block = [" ".join(f"b{j}x{k}" for k in range(30)) for j in range(4)]
    rows = [
        (1, " ".join(said)), (2, " ".join(own(2, 40) + said + own(2, 30))), (3, " ".join(own(3, 9) + said + own(3, 80))),
        (4, "\n".join(["one two", "", *block, "three"])), (5, "\n".join(["four", "", *block, "", "five six"])),
    ]
    out = {r["doc_id"]: r for r in para_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), run_words=RUN).collect()}
    assert [out[i]["text"].split() for i in (1, 2, 3)] == [said, own(2, 40) + own(2, 30), own(3, 9) + own(3, 80)]
    assert out[4]["text"] == rows[3][1] and out[5]["text"].split() == ["four", "five", "six"]
    assert all(out[i]["n_shared"] for i in range(1, 6))


def test_near_copies_over_short_lines(spark):
    """Short lines in a row are one paragraph, so an edited copy of them is found."""
    lines = [[f"n{j}x{k}" for k in range(12)] for j in range(8)]
    edited = [list(line) for line in lines]
    edited[1][5] = edited[4][6] = "edited"
    text = lambda ls: "\n".join(map(" ".join, ls))
    rows = [(1, "Title\n\n" + text(lines)), (2, "Other\n\n" + text(edited) + "\n\nend")]
    out = {r["doc_id"]: r for r in para_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), run_words=RUN).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"].split() == ["Other", "end"]


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is cut at its own places, whatever stands in other rows of its id; columns of the result's names are replaced."""
    said, other = " ".join(f"s{k}" for k in range(60)), " ".join(f"t{k}" for k in range(160))
    df = spark.createDataFrame([(1, said), (2, "a b\n" + said), (2, other), (2, other)], "doc_id long, text string").withColumn("cuts", F.lit(7))
    out = para_dedup.dedup_passages(df, run_words=RUN)
    assert sorted(r["text"] for r in out.collect()) == sorted([said, "a b", other, other]) and out.columns == ["doc_id", "text", "cuts", "n_shared", "class_id"]
