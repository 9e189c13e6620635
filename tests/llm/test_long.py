"""Very long texts of one kind: every text function stays linear (a quadratic one would take minutes here)."""

import pytest

from loomtext.llm import bpe, cutoff, fold, langid, leak, pairs, pii

N = 60_000
TEXTS = {
    "spaces": "a" + " " * N + "b", "letters": "a" * N, "arabic": "ا" * N, "dots": "x" + "." * N + "y", "newlines": "a" + "\n" * N + "b", "digits": "1" * N, "at": "a@" * (N // 2), "words": "word " * (N // 5), "brackets": "[" * N,
    "caps": "Aa" * (N // 2), "non-joiners": "ا" + "‌" * N + "ب", "capitalised": "Aaaa Bbbb " * (N // 10), "notes": "It came. " + "[7] " * (N // 4),
}


@pytest.mark.parametrize("name", TEXTS)
def test_long(name):
    text, folder = TEXTS[name], fold.Folder()
    cutoff.shape(text)
    langid.letters_of(text, folder)
    assert all(a < b for a, b in langid.segments(text))
    pii.Proposer(pii.Lexicon(frozenset(["grace"])))(text)
    list(pii.free_words(text, frozenset()))
    leak.words_of(text)
    pairs._NOT_TEXT.sub(" ", text)
    assert folder(folder(text)) == folder(text)
    b = bpe.tokenizer(bpe.DEFAULT_VOCABULARY)
    assert b.decode(b.encode(text)) == text


def test_what_was_put_behind_a_long_text():
    assert cutoff.stop_of("It came. And th" + " [7]" * 5000) == "It came. And th"
