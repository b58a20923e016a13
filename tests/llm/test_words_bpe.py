"""Words, shingles and byte-pair encoding."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridtide.llm.bpe import Vocabulary, decode_ids, encode_texts
from gridtide.llm.words import ALNUM, SPACED, Words, shingles, text_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "One  two\tTHREE\x1cfour é", "a", "Ä-b_c9", "x" * 300_000, "same same same", "same same same"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("kind", "pattern"), [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(kind, pattern):
    found = Words(pa.array(TEXTS), kind)
    want = [w for t in TEXTS for w in re.findall(pattern, lower(t))]
    assert [bytes(found.bytes[a:b]).decode() for a, b in zip(found.starts, found.ends, strict=True)] == want
    assert found.counts.tolist() == [len(re.findall(pattern, lower(t))) for t in TEXTS]
    hashes = dict(zip(want, found.hashes().tolist(), strict=True))
    assert [hashes[w] for w in want] == found.hashes().tolist()
    assert len(set(hashes.values())) == len(hashes)


def test_words_of_a_slice():
    whole = pa.array(TEXTS)
    assert Words(whole.slice(3, 3), SPACED).counts.tolist() == Words(whole, SPACED).counts[3:6].tolist()


def test_shingles_are_distinct_and_short_texts_have_one():
    text, value = shingles(Words(pa.array(["a b c d e f", "a b c d e", "a b", "", None, "a b"]), SPACED), 5)
    assert np.bincount(text, minlength=6).tolist() == [2, 1, 1, 0, 0, 1]
    assert value[text == 2] == value[text == 5]
    assert set(value[text == 1]) < set(value[text == 0])


def test_chunks_cover_every_row_once():
    column = pa.array(["ab", None, "c" * 50, "", "d"])
    assert [i for a, b in text_chunks(column, 3) for i in range(a, b)] == list(range(5))
    assert list(text_chunks(column.slice(0, 0), 3)) == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Vocabulary(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(library, own, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


@pytest.mark.parametrize("text", ["a<|endoftext|>b<|endoftext|>", "it's we'LL  \n\n x  y", "ab" * 5000, "\u0000\u001c\u0085é" * 40, "日本語 text ١٢٣ 👍🏽", "   ", "\n \n"])
def test_special_cases_equal_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_fragments_end_at_pairs_inside_no_token(own):
    tokens = set(own.bytes_of)
    for piece in (b" einheitzukeit", "naïve—x1".encode(), b"zq\xffjx"):
        parts = own.fragments(piece)
        assert b"".join(parts) == piece
        for a, b in zip(parts, parts[1:], strict=False):
            assert not any(a[-1:] + b[:1] in t for t in tokens)


def test_columns_rows_and_nulls(spark):
    rows = [(i, t, "kept", -1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    out = decode_ids(encode_texts(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == [t or "" for t in TEXTS]
    assert out[0]["ids"] == out[1]["ids"] == []
    assert out[7]["ids"] == out[8]["ids"]
    assert encode_texts(df.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert decode_ids(nothing, PATH).first()["decoded"] == ""


def test_pieces_and_texts_come_out_the_same_by_either_pattern(own):
    import random

    import pyarrow as pa
    import regex
    from gridtide.llm import bpe

    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t  'streadvéß3²\U0001d7d8\U0001f600x中،\x1c\x85") for _ in range(rng.randrange(50))) for _ in range(500)]
    texts += ["".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), ""]
    assert all(own.find(t) == regex.findall(bpe.PIECES, t) for t in texts)
    # Texts up to U+FFFF do not take the slower pattern.
    assert bpe.finder().findall(texts[-2]) == regex.findall(bpe.PIECES, texts[-2])
    ids = pa.array([*map(own.encode, texts), None], pa.list_(pa.int32()))
    tokens = pa.array(own.bytes_of, pa.large_binary())
    assert bpe.decoded(ids, tokens) == [*texts, ""]
    assert bpe.decoded(ids.slice(7, 30), tokens) == texts[7:37]
