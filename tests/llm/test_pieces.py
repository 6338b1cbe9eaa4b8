"""Piece encoding, decoding and places against the library."""

from __future__ import annotations

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece

from codeloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b   c", "▁", "▁ a", "\x00x", "naïve " * 50, "\U0001f600" * 30, "a" * 5000, " " * 5000, "x\n\n  y\t\tz", "<s> </s> <unk> <0x0A>", "��z", "é é", "퟿\U00100000 b", "the ▁▁the▁", "x.,;y_. (a)b. x²."]


def odd_texts(n):
    rng = random.Random(1)
    letters = " ▁\n\tabcdehlnorst.,'’éüß中文日本\U0001f600́\x7f0123_²)("
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    wide = ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return ODD + some + wide


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoding_and_places(library):
    model, texts = pieces.load(PATH), odd_texts(1500)
    for text, (ids, n, places, decoded) in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text)
        assert [int(i) for i in ids.split(b",") if i] == want and n == len(want)
        assert decoded == library.decode(want) == model.decode(want)
        assert places.tolist() == [[p.begin, p.end] for p in library.encode(text, return_type="proto").pieces]


def test_decoding_any_ids(library):
    model, rng = pieces.load(PATH), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map(rule):
    """The library's own maps: longest keys, replacements and where each normalised character comes from."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = dict(pieces.fields(library.serialized_normalizer_spec()))
    mine = object.__new__(pieces.Pieces)
    mine.map = pieces.CharacterMap(spec.get(2, b""))
    mine.prefix, mine.squeeze, mine.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    for text in ["ｱﾞ ㍿ ﬁ Ǆ", "　 x 　", "①②  ½", "가각", "ﷺ", *odd_texts(400)]:
        if "\x00" in text:
            continue
        want, places = library.normalize(text, with_offsets=True)
        got, source = mine.normalise(text)
        at, to = [0], [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        for c in got:
            to.append(to[-1] + len(c.encode()))
        assert got == want and [int(source[b]) for b in to] == [at[i] for i in places]


def test_query(spark, small, library):
    got = {r["doc_id"]: r for r in queries.op12_pieces(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = library.encode(text or "")
        r = got[doc]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rows(spark, library):
    """Nulls, repeated rows, columns with clashing names, an empty table; ids, places and texts on demand."""
    rows = [(1, None, 5), (2, "", 5), (3, "naïve \U0001f600 x", 5), (3, "naïve \U0001f600 x", 5), (None, "y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((d or 0, len(library.encode(t or ""))) for d, t, _ in rows)
    for r in got:
        if r["doc_id"] == 3:
            raw = "naïve \U0001f600 x".encode()
            assert r["ids"] == library.encode(raw.decode()) and r["decoded"] == raw.decode()
            assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == raw
            pairs = [n for p in zip(r["begins"], r["ends"], strict=True) for n in p]
            assert r["spans_crc32"] == zlib.crc32(b"".join(n.to_bytes(4, "little") for n in pairs))
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
