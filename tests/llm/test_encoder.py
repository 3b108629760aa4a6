"""The batch encoder against the whole tokenizer, and the work that it does."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rankloom.llm import store, tokens

VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n\n", "Élan élan ÉLAN (élan) élan.", "ÀÖØÞ ß ÿ Ÿ × ÷ a×b É÷é", "é É É́ ́a x ́", "don't DON'T 'S 's l'été '", "3.14 (2023) a1b22C x² ½ ٣٤",
    "<|endoftext|> <|ENDOFTEXT|> É<|endoftext|>É a<b <| |>", "no break space \x85 \x1c \x00nul", "ＷＩＤＥ Straße İstanbul ŞŢ ΑΒΓ Жж 漢字 かな 😀!", "a" * 300 + "É" * 300, "--É-- _x_ `q` ~~~ ^^ %$#@!", "\tTab\x0bVt\x0cFf\rCr",
]


def wanted(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCAB)
    return [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def split(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_encoder_as_whole_tokenizer():
    deal = random.Random(5)
    letters = "aAzZéÉßÿŸ×÷ñÑ 09.,'!<|>-́İİ\n\t 漢ſ"
    texts = ODD + ["".join(deal.choices(letters, k=deal.randrange(60))) for _ in range(3000)]
    for encoder in (tokens.Encoder(VOCAB), tokens.Encoder(VOCAB, 6)):
        assert split(*encoder.encode(pa.array(texts))) == wanted(texts)
        assert split(*encoder.encode(pa.array(texts).slice(4, 9))) == wanted(texts[4:13])
        assert split(*encoder.encode(pa.array(texts[:9], pa.large_string()), 7)) == [w[:-1] + [7] for w in wanted(texts[:9])]
    assert [x.tolist() for x in encoder.encode(pa.array([], pa.string()))] == [[], [0]]


def test_encoder_without_model_alone(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "_model_alone", lambda self: False)
    assert split(*tokens.Encoder(VOCAB).encode(pa.array(ODD))) == wanted(ODD)


def test_encoder_works_once_a_run():
    """Case, marks around letters and digits make no new work: neither a call of the whole tokenizer nor a second one of the model."""
    encoder, whole, runs = tokens.Encoder(VOCAB), [], []
    own_whole, own_run = encoder._whole, encoder._run
    encoder._whole = lambda piece: whole.append(piece) or own_whole(piece)
    encoder._run = lambda run: runs.append(run) or own_run(run)
    texts = ["Élan vital, (élan) ÉLAN-VITAL élan,vital", "ÉLAN 1999 9.1 vital... ...élan"] * 3
    for _ in range(2):
        assert split(*encoder.encode(pa.array(texts))) == wanted(texts)
    assert whole == [] and sorted(runs) == sorted({"élan", "vital", ",", "(", ")", "-", "1", "9", ".", "..."})


def test_encoder_stays_with_worker():
    assert tokens.encoder_of(VOCAB, 1000) is tokens.encoder_of(VOCAB, 1000)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_chunks_do_not_depend_on_neighbours(n):
    """Runs that are hashed together are cut as each would be alone."""
    deal = np.random.default_rng(n)
    parts = [deal.integers(0, 49_000, k).astype("<u4") for k in (3000, n, 20_000, 0, n, 9)] + [np.zeros(9000, "<u4")]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    together = list(store.Cutter().ends(np.concatenate(parts), at))
    assert together == [next(store.Cutter().ends(p, np.array([0, len(p)]))) for p in parts]
    for p, ends in zip(parts, together):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(p) and all(store.LEAST <= s <= store.MOST for s in sizes[:-1]) and all(0 < s <= store.MOST for s in sizes)


def test_chunks_do_not_depend_on_blocks(monkeypatch):
    """Cuts are the same by any size of the blocks that are hashed at a time."""
    ids = np.random.default_rng(1).integers(0, 49_000, 50_000).astype("<u4")
    at = np.array([0, 30_000, 50_000])
    want = list(store.Cutter().ends(ids, at))
    for block in (1, 17, 1000, 29_999):
        monkeypatch.setattr(store, "BLOCK", block)
        assert list(store.Cutter().ends(ids, at)) == want
    assert all(len(ends) > 20 for ends in want)
