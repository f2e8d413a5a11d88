"""Finding 1 of round 2: the stages that read every character, faster with the same results."""

import random
import re

import public_tokenizers
import tokenizers

from lodestone.llm import packing, pii


def test_ids_of_plain_text_with_and_without_meeting_blanks():
    assert packing.tokenizer() is packing.tokenizer()  # loaded once in a process
    whole, rng = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    parts = ["a", "bc", " ", " ", "\n", "\t", "\r", "'s", "'ll", "9", "!?", "é", "Ab", "don't", "\n\n", "  ", "…", "<|endoftext|>"]
    for most in (14, 16, len(parts)):
        texts = ["".join(rng.choices(parts[:most], k=rng.randint(0, 14))) for _ in range(2000)]
        assert packing.tokenizer()(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_signs_of_disguises_in_lower_case_are_those_of_any_case():
    """The former patterns, which ignore case, against the searches of a lower-cased text."""
    at, dot, word = pii._ATWORD, pii._DOTWORD, pii._WORD
    sign = re.compile(rf"[\[({{<]\s{{0,2}}(?:{at}|{dot}|@|\.)\s{{0,2}}[\])}}>]|\s(?:{dot})\s|\s@|@\s|(?<!\w)(?:plus|más) |[0-9][ ().-]{{0,2}}[OolI]|[OolI][ ().-]{{0,2}}[0-9]|[­​-‏⁠﻿]", re.I)
    spelled = re.compile(rf"(?<!\w)(?:{word})[ \-.,]{{1,2}}(?:{word}|[0-9])|[0-9][ \-.,]{{1,2}}(?:{word})(?!\w)", re.I)
    rng, found = random.Random(5), 0
    parts = ["one", "TWO", "fİve", "sıx", "dot", "PUNKT", "at", "[at]", "( Dot )", "@", ".", " ", " ", "-", "Plus ", "MÁS ", "12", "7", "O", "l", "İ", "ı", "FÜNF", "ZÉRO", "​", "­", "x", "\n", ","]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        low = pii._lower(text)
        assert pii._triggered(low) == bool(sign.search(text)) and bool(pii._SPELL_TRIGGER.search(low)) == bool(spelled.search(text))
        found += pii._triggered(low)
    assert 2000 < found < 19000


def test_addresses_of_hosts_start_with_their_run_of_digits():
    old = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
    rng = random.Random(6)
    for _ in range(20000):
        text = "".join(rng.choices(["1", "22", "255", ".", ".", " ", "x", "0000"], k=rng.randint(1, 16)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in old.finditer(text)]
