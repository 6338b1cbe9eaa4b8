"""Repeated and null ids, ties, clashing columns and long texts, against brute force."""

from __future__ import annotations

import itertools
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import kd_search, line_dedup, passages, toxicity, warc
from codeloom.llm.common import remove_path, stage_table

DOCS = "doc_id long, text string"


def test_search_like_brute_force(spark, monkeypatch):
    """Vectors of several lengths, repeated ids and vectors, over many shards."""
    monkeypatch.setattr(kd_search, "SHARD", 60)
    monkeypatch.setattr(kd_search, "LENGTHS", 2)
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.integers(-9, 9, 4) / 16]) for i in r.integers(0, 500, 600)] + [(150, [0.5, 0.5, 0.5, 0.5])] * 90
    rows += [(50, [1.0]), (100, [1.0]), (0, [2.0]), (3, [1.0, 2.0]), (100, [1.0, 1.0]), (None, [1.0]), (200, None), (200, [None]), (250, [float("nan")]), (300, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for q, rank, vec, score in sorted(map(tuple, kd_search.top_k(vectors, vectors["vec_id"] % 50 == 0, 5).collect())):
        got[q].append((rank, vec, score))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = defaultdict(list)
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:5]
            want[q] += [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}


def test_warc_repeated_ids(spark):
    body, other = "x" * 120, "y" * 120
    rows = [(1, "http://a/b", body), (5, "http://a/c", body), (5, "http://a/d", other), (5, "http://a/d", other), (7, "u", other), (None, "http://n", body), (3, "s", "short"), (2, "s", "short"), (9, "w", None), (9, "w", None)]
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter([(1, "response", None, 120), (5, "revisit", 1, 120), (5, "response", None, 120), (5, "response", None, 120), (7, "revisit", 5, 120), (None, "revisit", 1, 120), (3, "response", None, 5), (2, "response", None, 5), (9, "response", None, 0), (9, "response", None, 0)])


def test_warc_streams(monkeypatch):
    import gzip

    record = lambda i, block: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    blocks = [b"", b"WARC/1.1\r\n\r\n", b"z" * 5000, b"\r\n\r\nWARC/"]
    whole = [record(i, b) for i, b in enumerate(blocks)]
    monkeypatch.setattr(warc, "PIECE", 7)
    for data in (b"".join(whole), gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        assert [r[0] for r in warc.parse_archive(warc.decompressed(data))] == [f"<{i}>" for i in range(len(blocks))]
    assert list(warc.parse_archive(warc.decompressed(gzip.compress(whole[2])[:-20])))[0][0] == "<2>"


def test_warc_captures(spark):
    """One nested row for each response; of several metadata records the one with the smallest id."""
    record = lambda i, kind, to=None: (i, kind, to, "t", None, None, 0, {"n": i} if kind == "metadata" else None, None)
    rows = [record("r1", "response"), record("r2", "revisit"), record("q1", "request", "r1"), record("m2", "metadata", "r1"), record("m1", "metadata", "r1"), record("q9", "request", "r9")]
    got = {r["response"]["record_id"]: r for r in warc.captures(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["request"]["record_id"] == "q1" and got["r1"]["metadata"]["record_id"] == "m1"
    assert got["r2"]["request"] is None and got["r2"]["metadata"] is None


def test_long_texts_lose_lines_in_linear_time(spark):
    text = "\n".join(f"line {i} of text {i * 7 % 13}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "first\n" + text), (3, "x")], DOCS)
    start = time.perf_counter()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert time.perf_counter() - start < 60
    assert got == {1: (text, 0), 2: ("first", 200_000), 3: ("x", 0)}


@pytest.mark.parametrize("operator", [line_dedup.remove_repeated_lines, passages.remove_repeated_passages])
def test_clashing_columns(spark, operator):
    passage = "one first line here\nanother second line\nand the third line"
    docs = spark.createDataFrame([(1, passage, 1, 2, 3, "a", 9), (2, "x\n" + passage, 4, 5, 6, "b", 9), (2, "x\n" + passage, 4, 5, 6, "c", 9)], "doc_id long, text string, covered long, _id long, n_lines long, row string, n_chars long")
    got = sorted(operator(docs).collect(), key=lambda r: r["row"])
    assert [(r["text"], r["covered"], r["_id"], r["n_chars"]) for r in got] == [(passage, 1, 2, len(passage)), ("x", 4, 5, 1), ("x", 4, 5, 1)]
    if operator is passages.remove_repeated_passages:
        assert got[0]["n_lines"] == 3 and got[0].asDict().keys() == set(docs.columns)


def test_drop_toxic_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x", 3, "r"), (None, None, 4, "s")], "doc_id long, text string, score long, row string")
    got = toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(docs.collect(), key=str)


def test_decode_like_enumeration():
    """The search's reading is one of the likeliest of all readings of the lattice."""
    r = np.random.default_rng(3)
    model = toxicity.log_model(r.integers(0, 60, toxicity.CLASSES**3).astype(float))

    def log_weight(readings):
        word, total = "".join(x for x, _ in readings), sum(w for _, w in readings)
        c = [0, 0, *map(toxicity.char_class, word), 0]
        return total + sum(float(model[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))

    for span in ("1d10t", "st00pid", "w0rthle55", "aaab", "l o s e r", "x", "|1!", "é3 é"):
        best: dict[str, float] = {}
        for readings in itertools.product(*toxicity.lattice(span)):
            word = "".join(x for x, _ in readings)
            best[word] = max(best.get(word, -1e9), log_weight(readings))
        assert best[toxicity.decode(span, model)] == pytest.approx(max(best.values()), abs=1e-4)


def test_sign_runs_are_restored():
    words = "stupid worthless idiot moron loser".split() * 50 + "stoop worth less wood food mood".split() * 20
    text = " ".join(words)
    counts = np.zeros(toxicity.CLASSES**3)
    c = [toxicity.char_class(x) for x in text]
    for i in range(len(c) - 2):
        counts[(c[i] * toxicity.CLASSES + c[i + 1]) * toxicity.CLASSES + c[i + 2]] += 1
    model = toxicity.log_model(counts)
    for span, word in {"w0rthle55": "worthless", "1diot": "idiot", "m0r0n": "moron", "l o s e r": "loser", "m.o.r.o.n": "moron", "iiidiot": "idiot", "5t00p": "stoop", "w00d": "wood"}.items():
        assert toxicity.decode(span, model) == word


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from codeloom.llm import common

    class Context:
        master, applicationId = "yarn", "a"
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_discard(spark):
    from codeloom.llm import common

    t = stage_table(spark.range(3).toDF("a"), "t")
    path = common._paths[t]
    assert t.count() == 3
    common.discard(t)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    remove_path(spark, path)
