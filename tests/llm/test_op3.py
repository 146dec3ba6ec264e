import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from weftline.llm import op3_sentencepiece as op3

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


HARD = ["", " ", "  ", "   a", "a   ", "\n", "\n\n a\n", " \n \n", "a▁b", "▁", "\x00", "￿☃ 😀x", "\r\n\t;\r", "<s></s><0x0A>", "a" * 5000, "ab☃" * 3000, " " * 300 + "x" + " " * 77, "naïve café́", "𝔘𝔫𝔦"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(library, text):
    ids, decoded = op3.codec(PATH).encode(text)
    want = library.encode(text, add_eos=True)
    assert ids.tolist() == want
    assert decoded == library.decode(want) == op3.codec(PATH).decode(want)


def test_random_texts(library):
    rng = random.Random(5)
    alphabets = ["ab ", "theraion \n", "ehlo wrd.,!\t ", "éàüß ñó語漢😀 a\n", " ▁\n\r;)}", "0123456789abcdef+-=/ "]
    for k in range(3000):
        text = "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randrange(1, 60)))
        ids, decoded = op3.codec(PATH).encode(text)
        want = library.encode(text, add_eos=True)
        assert ids.tolist() == want, text
        assert decoded == library.decode(want), text


def test_decode_random_ids(library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(1, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(8)]
        assert op3.codec(PATH).decode(ids) == library.decode(ids), ids


def test_query_equals_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in op3.op3_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_extra_columns_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, None, "x")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, op3.digests(op3.encode_decode(df, PATH)).select("doc_id", "n_tokens").collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 3)]
    assert op3.encode_decode(df.limit(0), PATH).count() == 0


def test_short_parts_are_merged_together(library, monkeypatch):
    rng = random.Random(8)
    alphabets = ["etaoinsr", "abc", "éàüß語漢😀☃\x00", "0123456789abcdef+-=/", "\r\t;)}<s>"]
    texts = [" ".join("".join(rng.choice(a) for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "▁", "  "]) for a in rng.choices(alphabets, k=30)) for _ in range(300)]
    texts += ["", "x" * 5000, " ", "\n"]
    walked = []
    walk = op3.MergeCodec.tokens
    monkeypatch.setattr(op3.MergeCodec, "tokens", lambda self, part: walked.append(part) or walk(self, part))
    own = op3.MergeCodec(PATH)
    own.prepare(texts)
    assert not walked and len(own.marked) + len(own.plain) > 5_000
    for text in texts:
        ids, decoded = own.encode(text)
        want = library.encode(text, add_eos=True)
        assert ids.tolist() == want, text
        assert decoded == library.decode(want), text
    assert len(walked) < len(own.marked) / 10  # one walk a distinct word before; now only newlines and long parts
    for cache in (own.marked, own.plain):
        assert all(own.part(cache.prefix + word) == value for word, value in cache.items() if value)


def _rows_equal(own, library, texts):
    ids, counts, decoded = own.rows(pa.array(texts, pa.string()))
    assert len(counts) == len(decoded) == len(texts)
    at = 0
    for text, n, d in zip(texts, counts.tolist(), decoded.to_pylist(), strict=True):
        want = library.encode(text or "", add_eos=True)
        assert ids[at : at + n].tolist() == want, text
        assert d == library.decode(want), text
        at += n
    assert at == len(ids)


def _mixed_texts(count):
    rng = random.Random(9)
    alphabets = ["ab ", "theraion \n", "ehlo wrd.,!\t ", "éàüß ñó語漢😀 a\n", " ▁\n\r;)}", "0123456789abcdef+-=/ ", "漢語字☃", "\x00\x7f <s>/"]
    return [None, *HARD, *("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randrange(0, 150))) for k in range(count)), "", None]


def test_rows_are_encoded_together(library, monkeypatch):
    own = op3.MergeCodec(PATH)
    monkeypatch.setattr(op3.MergeCodec, "encode", lambda *_: pytest.fail("a row was encoded on its own"))
    _rows_equal(own, library, _mixed_texts(2000))
    _rows_equal(own, library, [])
    _rows_equal(own, library, [None, ""])
    before = own.known.parts
    _rows_equal(own, library, ["zorvalon, zorvalon. zorvalon; zorvalon! zorvalon: zorvalon? zorvalon1 zorvalon22"])
    assert own.known.parts <= before + 9  # the word, and at most each character after it, not eight words


def test_parts_under_one_hash(library, monkeypatch):
    alone = []
    encode, hashes = op3.MergeCodec.encode, op3._hashes
    monkeypatch.setattr(op3.MergeCodec, "encode", lambda self, text: alone.append(text) or encode(self, text))
    monkeypatch.setattr(op3, "_hashes", lambda *x: hashes(*x) % 5)
    texts = _mixed_texts(200)
    _rows_equal(op3.MergeCodec(PATH), library, texts)
    assert len(alone) == len(texts)


def test_bounded_arrays_and_long_rows(library, monkeypatch):
    monkeypatch.setattr(op3, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(op3, "KNOWN_PARTS", 2_048)
    monkeypatch.setattr(op3, "KNOWN_IDS", 9_000)
    own = op3.MergeCodec(PATH)
    cleared = []
    clear = own.known.clear
    monkeypatch.setattr(own.known, "clear", lambda: cleared.append(own.known.parts) or clear())
    _rows_equal(own, library, _mixed_texts(1500))
    assert cleared and max(cleared) <= 2_048
