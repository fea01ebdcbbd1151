import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tokens, wavelet

PATH = tokens.vocabulary("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1500))
def test_matrix_answers_from_its_file(ids):
    packed = wavelet.WaveletMatrix.build(np.array(ids, dtype=np.uint32)).pack(np.array([len(ids)]), ["1"])
    matrix, lengths, names = wavelet.WaveletMatrix.unpack(packed)
    assert lengths.tolist() == [len(ids)] and names == ["1"] and matrix.ids().tolist() == ids
    for place in range(0, len(ids), 97):
        assert matrix[place] == ids[place]
    for token in (0, 1, 7, 70, 1000, -1):
        assert matrix.count(token) == ids.count(token)
        assert matrix.count(token, 3, min(900, len(ids))) == ids[3:900].count(token)
        assert matrix.places(token) == [i for i, x in enumerate(ids) if x == token]


def test_places_over_many_blocks():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    ids[rng.integers(0, 20_000, 300)] = 4242
    matrix = wavelet.WaveletMatrix.build(ids)
    assert matrix.places(4242) == np.flatnonzero(ids == 4242).tolist() and np.array_equal(matrix.ids(), ids)


def test_shards_hold_all_documents_in_key_order(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    rows = [(i, f"text number {i}\nwith  odd\tspace <|endoftext|> é" * (i % 7), i) for i in range(60)]
    rows += [(60, None, 1), (61, "", 1), (62, "w " * 5000, 1), (62, "w " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(5)
    shards = wavelet.write_shards(df, PATH, shard_tokens=300)
    assert shards.count() > 4
    got = sorted(tuple(r) for r in wavelet.documents(shards).collect())
    want, at, everything = [], 0, []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
        everything += ids
    assert got == want
    places = sorted(r["place"] for r in wavelet.occurrences(shards, 2).collect())
    assert places == [i for i, x in enumerate(everything) if x == 2]


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "c"), (None, "a")], "doc_id bigint, text string")
    found = wavelet.documents(wavelet.write_shards(df, PATH)).collect()
    assert sorted((r["start"], r["doc_id"]) for r in found) == [(0, None), (2, 3)]
    assert wavelet.documents(wavelet.write_shards(df.limit(0), PATH)).collect() == []


def test_keys_come_from_the_files_with_every_digit(spark):
    wide = [None, 9007199254740993, 9007199254740995, -9223372036854775808]
    df = spark.createDataFrame([(k, "x") for k in wide], "doc_id bigint, text string").coalesce(1)
    shards = wavelet.write_shards(df, PATH)
    assert "keys" not in shards.columns
    assert [r["doc_id"] for r in wavelet.documents(shards).orderBy("start").collect()] == sorted(wide, key=lambda k: (k is not None, k))
    texts = spark.createDataFrame([("b\"ü", "x"), ("a", "y")], "`the key` string, text string")
    found = wavelet.documents(wavelet.write_shards(texts, PATH, key="the key"), "the key", "string").orderBy("start").collect()
    assert [r["the key"] for r in found] == ["a", "b\"ü"]


class Watched:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.own, self.seen, self.fails = tokenizer, [], False

    def encode_batch_fast(self, texts, **options):
        if self.fails:
            raise MemoryError
        self.seen += texts
        return self.own.encode_batch_fast(texts, **options)


def test_pieces_are_joined_to_short_texts():
    words = [f"w{n}{'.' * (n % 3)}{'ä' * (n % 2)}" for n in range(3000)]
    encode = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True)
    plain, encode.tokenizer = encode.tokenizer, Watched(encode.tokenizer)
    texts = [" ".join(words[n:n + 60]) + "\n" + words[n] for n in range(0, 3000, 50)]
    for _ in range(2):
        found = encode(texts)
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(t.count("\n") for t in encode.tokenizer.seen) < 64
    # No piece is encoded again in the second round.
    assert sum(t.count("\n") + 1 for t in encode.tokenizer.seen) <= len(set(words)) + 100


def test_a_failed_call_leaves_no_empty_piece():
    encode = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True)
    plain, encode.tokenizer = encode.tokenizer, Watched(encode.tokenizer)
    encode.tokenizer.fails = True
    with pytest.raises(MemoryError):
        encode(["some words, not known yet."])
    encode.tokenizer.fails = False
    assert np.frombuffer(encode(["some words, not known yet."])[0], dtype="<u4").tolist() == plain.encode(
        "some words, not known yet.", add_special_tokens=False).ids


def test_a_distinct_piece_is_looked_up_once_in_a_call():
    encode = tokens.Encoder(PATH, True)

    class Counted(type(encode.young)):
        looked = 0

        def __getitem__(self, piece):
            Counted.looked += 1
            return super().__getitem__(piece)

        def get(self, piece, *other):
            Counted.looked += 1
            return super().get(piece, *other)

    young = Counted()
    young.update(encode.young)
    encode.young = young
    texts = ["some few words, said again and again\nand once more."] * 500
    assert len(set(encode(texts))) == 1
    # Two look-ups of a new piece, and some for marks that are encoded apart.
    assert Counted.looked < 60
    assert len(set(encode(texts))) == 1 and Counted.looked < 80


def test_pieces_after_blanks_are_joined_without_separators():
    encode = tokens.Encoder(PATH, True)
    plain, encode.tokenizer = encode.tokenizer, Watched(encode.tokenizer)
    texts = ["a " + " ".join(f"w{n}'s-{'é' * (n % 3)}我{n % 7}" for n in range(k, k + 40)) for k in range(0, 2000, 40)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(t.count("\n") for t in encode.tokenizer.seen) == 0
    assert max(t.count(" ") for t in encode.tokenizer.seen) < 64


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_arrow_texts_in_stretches(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "CALL_BYTES", 40)
    texts = ["a b", None, "", "é " * 50 + "x", "two  blanks", "a\nb, c.", "<|endoftext|> z", "\n", None, "a b"]
    encode = tokens.Encoder(tokens.vocabulary(name), spaced)
    want = [np.array(encode.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts if "<" not in (t or "")]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *texts], kind)[1:]
        cuts = list(tokens.stretches(column))
        assert [low for low, _ in cuts] == [0, *[high for _, high in cuts[:-1]]] and cuts[-1][1] == len(texts) and len(cuts) > 2
        got = [ids for low, high in cuts for ids in encode(column[low:high])]
        assert got == encode(texts) and got[:6] + got[7:] == want
    assert list(tokens.stretches(pa.array([], pa.string()))) == [] and encode([]) == []


def test_marks_are_taken_off_before_a_piece_is_looked_up():
    encode = tokens.Encoder(PATH, True)
    plain, encode.tokenizer = encode.tokenizer, Watched(encode.tokenizer)
    text = "so " + " ".join(f"w{'abcdefgh'[n]}{mark}" for n in range(8) for mark in ("", ",", ".", "!!", "?,", "7."))
    assert np.frombuffer(encode([text])[0], dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert "wa" in encode.young
    assert not any(piece[-1:] in tokens.MARKS and piece[-2:-1].isalpha() for piece in encode.young)


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_marks_after_letters_that_fall_apart(name, spaced):
    encode = tokens.Encoder(tokens.vocabulary(name), spaced)
    letters = "aÀİßΣक\u0915\u093c\u0958\u095e\u09dc\u09df\u0a33\u0a5e\u0b5c\u0f43\u0f69\ufb1d\ufb2a\ufb4e\uac00한ﬁ"
    texts = [f"x{c}., y{c}!\n{c}, {c}" for c in letters]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
