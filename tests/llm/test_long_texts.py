"""Texts without any place to cut: time must stay in proportion, results must not change."""

import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtide.llm import bpe, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_allow_list_is_the_same_as_with_backtracking():
    plain = re.compile(r"[A-Z]?[a-z]+([_/-][A-Za-z]*[a-z]+)*[0-9]{1,4}")
    rng = random.Random(1)
    for _ in range(100_000):
        text = "".join(rng.choice("abZY_/-19") for _ in range(rng.randint(1, 12)))
        assert bool(plain.fullmatch(text)) == bool(secrets.ALLOWED[3].fullmatch(text)), text


@pytest.mark.parametrize("text", ["a_" + "b" * 1_000_000 + "+1", "a" + "_b" * 500_000 + "+1", "a_" + "bC" * 500_000 + "1", "x" * 1_000_000])
def test_long_candidates_are_judged_at_once(text):
    begun = time.process_time()
    secrets.allowed(text)
    assert time.process_time() - begun < 2


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(PATH)


def test_long_runs_equal_the_library(own):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "é中a") for n in (65, 200, 3000)]
    for text in [*texts, "a" * 5000, "ab" * 3000, "0123456789abcdef" * 300]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs_take_time_in_proportion(own):
    rng = random.Random(3)
    took = []
    for n in (20_000, 160_000):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        begun = time.process_time()
        own.encode(text)
        took.append(time.process_time() - begun)
    assert took[1] < 20 * took[0] + 0.5
    assert took[1] < 8
