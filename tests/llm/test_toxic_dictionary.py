"""The toxic dictionary is trained by zstandard on toxic texts, and tells them from ordinary ones."""

import random

import numpy as np
import zstandard

from lattica.llm import toxicity
from lattica.llm.toxicity import ORDINARY_BYTES, TOXIC_BYTES, _of_texts, fit

INSULTS = ["blockhead", "nincompoop", "dunderwit", "scallywag", "numbskull"]


def _sample(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "el", "sou", "mi", "ke", "da"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        if i % 3 == 0:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def _scores(model, texts):
    x = _of_texts(model.tools(), texts)
    return 1 / (1 + np.exp(-(x @ model.beta[:-1] + model.beta[-1])))


def test_both_dictionaries_are_trained(monkeypatch):
    calls = []
    train = zstandard.train_dictionary

    def watched(most, samples, **how):
        calls.append((most, samples))
        return train(most, samples, **how)

    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", watched)
    model = fit(_sample(900, 1))
    assert sorted(m for m, _ in calls) == [TOXIC_BYTES, ORDINARY_BYTES]
    toxic = next(s for m, s in calls if m == TOXIC_BYTES)
    assert len(toxic) > 100 and all(any(w.encode() in s for w in INSULTS) for s in toxic)  # one sample a toxic text, each with its wording
    assert all(w.encode() in model.toxic for w in INSULTS)


def test_held_out_texts_are_told_apart():
    model = fit(_sample(900, 1))
    rows = _sample(600, 2)
    score = _scores(model, [t for t, _ in rows])
    truth = np.array([y for _, y in rows]) == 1
    assert (score[truth] >= 0.5).mean() > 0.95 and (score[~truth] >= 0.5).mean() < 0.02


def test_ordinary_windows_come_from_whole_texts():
    sample = [(f"opening words {i} " + "".join(f"filler{i * k} " for k in range(300)) + "a closing passage of the whole text", 0) for i in range(60)]
    sample += [("vile wording " * 5, 1)] * 30
    assert b"closing passage" in fit(sample).ordinary


def test_late_passages_of_long_texts_count():
    """Wording behind a megabyte of ordinary text is found, and training reads whole texts."""
    rng = random.Random(5)
    plain = " ".join(rng.choice(["tari", "noel", "soumi", "keda"]) for _ in range(200_000))
    model = fit(_sample(900, 1))
    tools = model.tools()
    clean, late = _of_texts(tools, [plain]), _of_texts(tools, [plain + " you blockhead you nincompoop"])
    assert late[0, 0] > clean[0, 0]
