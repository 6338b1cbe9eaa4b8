"""Removal of repeated passages in any surroundings."""

from __future__ import annotations

import random

from codeloom.llm.passages import remove_repeated_passages, without

DOCS = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(9999)}" for _ in range(n)]


def removed(spark, rows):
    return {r["doc_id"]: r["text"] for r in remove_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}


def runs(text, n=51):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_passages_inside_lines(spark):
    rng = random.Random(4)
    passage, sentence = words(rng, 60), " ".join(words(rng, 55)) + "."
    rows = [(1, " ".join(words(rng, 20) + passage + words(rng, 20)))]
    rows += [(i, " ".join(words(rng, 13 + i) + passage + words(rng, 9))) for i in range(2, 8)]
    rows += [(10, sentence), (11, sentence), (12, "Before it. " + sentence + " After it."), (13, "x " * 300), (14, "x " * 200)]
    got = removed(spark, rows)
    assert got[1] == rows[0][1] and got[10] == sentence and got[11] == "" and got[12] == "Before it. After it."
    seen = set()
    for doc, text in sorted(got.items()):
        assert not runs(text) & seen, doc
        seen |= runs(text)
    for doc, text in rows[1:7]:
        before, after = text.split()[: 13 + doc], text.split()[-9:]
        assert got[doc].split()[: 13 + doc] == before and got[doc].split()[-9:] == after


def test_odd_rows(spark):
    passage = "one line\nsecond  line\n\nthird line"
    chars = "".join(chr(0x4E00 + 7 * i) for i in range(120))
    rows = [(2, f"x\n{passage}\ny"), (1, f"{passage}\nmore"), (3, passage), (4, None), (5, ""), (None, passage), (6, "one line\nsecond line"), (7, "A. B. C."), (8, "A. B. C."), (20, chars), (21, f"前{chars}")]
    got = removed(spark, rows)
    assert got[21].startswith("前") and len(got.pop(21)) < 12
    assert got == {1: f"{passage}\nmore", 2: "x\n\ny", 3: "", 4: None, 5: "", None: passage, 6: "one line\nsecond line", 7: "A. B. C.", 8: "A. B. C.", 20: chars}
    assert removed(spark, []) == {}


def test_pipeline_uses_passages(spark):
    import corpus_pipeline

    line = " ".join(words(random.Random(5), 80))
    docs = spark.createDataFrame([(1, line, 0), (2, "Own words. " + line, 0)], DOCS + ", n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert got == {1: (line, len(line)), 2: ("Own words.", 10)}


def test_without():
    assert without(b"  a b c d\ne f\n\ng h i ", [(1, 3), (4, 6), (8, 9)]) == b"  a d\n\ng h"


def test_borders_of_known_passages(spark):
    """A copy of a document that quotes a passage makes its border windows repeated; the passage goes all the same."""
    passage = "\n".join(f"passage line {i}" for i in range(4))
    quoting = f"alpha one\nalpha two\n{passage}\nomega one\nomega two"
    got = removed(spark, [(1, passage), (2, quoting), (3, quoting), (4, "same\n" * 5 + "other")])
    assert got == {1: passage, 2: "alpha one\nalpha two\nomega one\nomega two", 3: "", 4: "same\nsame\nsame\nother"}


def test_pipeline_drops_emptied_rows(spark):
    import corpus_pipeline

    text = "\n".join(f"line {i} of a text" for i in range(5))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "\n" + text), (4, ""), (5, None), (6, " \n")], DOCS)
    clean = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {(1, text), (4, ""), (5, None), (6, " \n")}
    kept = corpus_pipeline.without_near_duplicates(spark, clean, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
