import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, tokens

PATH = tokens.vocabulary("word_bpe_49k.json")


def check_plan(histogram, capacity):
    rows = packing.plan(histogram, capacity)
    by_length, places = defaultdict(list), defaultdict(list)
    for length, first, count, sequence, offset in rows:
        by_length[length].append((first, count))
        for k in range(count):
            places[sequence + k].append((offset, length))
    for length, total in histogram.items():
        at = 0
        for first, count in sorted(by_length[length]):
            assert first == at
            at += count
        assert at == total
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    return len(places), len(rows)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_places_every_piece_once(histogram):
    used, _ = check_plan(histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    # Best fit never leaves two sequences that would fit into one on average.
    assert used <= max(1, 2 * -(-total // 64)) if total else used == 0


def test_large_pieces_are_matched():
    assert check_plan({2048: 5, 1400: 10, 648: 10}, 2048)[0] == 15
    assert check_plan({1024: 7}, 2048)[0] == 4
    assert check_plan({700: 9}, 2048)[0] == 5
    assert check_plan({700: 4, 648: 4}, 2048)[0] == 3
    assert check_plan({1000: 1}, 2048)[0] == 1
    assert check_plan({1: 2048 * 3}, 2048)[0] == 3


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in enumerate(rng.integers(1, 1000, 2048), 1)}
    large = packing.plan({n: c * 10**9 for n, c in counts.items()})
    assert len(large) < 40_000
    total = sum(n * c for n, c in counts.items())
    used, _ = check_plan(counts, 2048)
    assert used <= 1.02 * -(-total // 2048)


def encoded(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_documents_become_gapless_sequences(spark):
    long = "word another, " * 4000
    rows = [(1, "Hello, world! it's 23", 9), (2, None, 1), (3, "", 1), (4, long, 2), (5, "Hello, world! it's 23", 3),
            (None, "no id", 4), ((1 << 53) + 1, "a b <|endoftext|> c<|startoftext|>D", 1), ((1 << 53) + 3, "x", 1), (1, "Hello, world! it's 23", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").repartition(3)
    found = packing.packed(df, PATH, keep_ids=True)
    got = found.collect()
    texts = {1: rows[0][1], 2: None, 3: "", 4: long, 5: rows[0][1], None: "no id", (1 << 53) + 1: rows[6][1], (1 << 53) + 3: "x"}
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = encoded(text)
        want = [(k, 2048 * k, len(ids[2048 * k:2048 * (k + 1)]),
                 zlib.crc32(np.array(ids[2048 * k:2048 * (k + 1)], dtype="<u4").tobytes()))
                for k in range(-(-len(ids) // 2048))]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key])
        assert own == sorted(want * (2 if key == 1 else 1))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 2048)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(found).collect()}
    for number, items in bins.items():
        at = 0
        for offset, length, _ in sorted(items, key=lambda x: x[0]):
            assert offset == at
            at += length
        assert whole[number] == b"".join(bytes(x[2]) for x in sorted(items, key=lambda x: x[0]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed(df, PATH).collect() == []


ODD = ["a", "B", "é", "ß", "İ", "Σ", "σ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1e", "\x1c", "\x00", "́", " ",
       "　", "'s", "'ll", "1", "23", ".", ",", "!!", "#", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "</w>", "你好", "😀", "ﬁ", "x" * 70, "|", "-"]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, spaced, monkeypatch):
    import random
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "a b\nc, d."]
    from tokenizers import Tokenizer
    encode, library = tokens.Encoder(tokens.vocabulary(name), spaced), Tokenizer.from_file(tokens.vocabulary(name))
    got = [ids for at in range(0, len(texts), 64) for ids in encode(texts[at:at + 64])]
    for text, ids in zip(texts, got, strict=True):
        want = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert ids == want, repr(text)


def test_many_new_words_are_joined_to_short_texts():
    words = [f"w{'abcdefghij'[n % 10] * (n // 10 % 7)}{n}{'.' * (n % 3)}" for n in range(3000)]
    encode = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    plain, seen = encode.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encode.tokenizer = Watched()
    texts = [" ".join(words[n:n + 60]) for n in range(0, 3000, 50)]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(t.count("\x1e") for t in seen) < 64
