import random
import time
from itertools import product

import numpy as np
import pytest

from convoy.llm import toxicity
from convoy.llm.common import texts
from convoy.llm.toxicity import SIZE, _Words, language_model, letter_trigrams, restored_words, toxicity_scores

BAD = "blornak grimpus snarvel".split()
ODD = {"blornak": ["bl0rnak", "b-l-o-r-n-a-k", "blornaaaak", "b l o r n a k"], "grimpus": ["gr1mpu5", "g.r.i.m.p.u.s", "grimpuuuus", "g r i m p u s"], "snarvel": ["$n4rv3l", "snarv_el", "ssssnarvel", "s n a r v e l"]}


@pytest.fixture(scope="module")
def rows(make_prose):
    rng, out, labels = random.Random(2), [], []
    for i in range(360):
        words, bad = make_prose(i + 400, rng.randint(20, 120)).split(), i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return out, labels


@pytest.fixture(scope="module")
def tables(spark, rows):
    out, labels = rows
    hidden = [(1000 + k, f"the river {odd} walks under quiet light and {odd} too") for k, odd in enumerate(x for xs in ODD.values() for x in xs)]
    clean = [(2000 + k, t) for k, t in enumerate(["the 7 birds carry 12 letters", "a b c d e f", "water!!! light*** 99%", "looooong letters", "x1y2z3 token=4f5a"])]
    return spark.createDataFrame(out + hidden + clean, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_hidden_words(tables, rows):
    found = {r.doc_id: r for r in toxicity_scores(*tables).collect()}
    labels = dict(rows[1])
    held = [i for i in labels if found[i].held_out]
    assert np.mean([found[i].predicted == labels[i] for i in held]) >= 0.97
    assert np.mean([found[i].predicted for i in found if 1000 <= i < 2000]) >= 0.9
    assert not any(found[i].predicted for i in found if i >= 2000)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())


def test_restored_words(tables):
    words = _Words(language_model(texts(tables[0])))
    for word, odd in ODD.items():
        for x in odd[:3]:
            assert words[x] == word
    assert words["letters,"] == "letters" and words["RIVER!!"] == "river" and words["***"] == "" and words[""] == ""
    assert "blornak" in restored_words("so b l o r n a k it is", words)


def test_letters_set_apart_beside_short_words(tables):
    words = _Words(language_model(texts(tables[0])))
    for word in BAD:
        twos = " ".join(word[k : k + 2] for k in range(0, len(word), 2))
        for form in (" ".join(word), "  ".join(word), "\n".join(word), twos, twos.replace(" ", "\t \n"), " ".join(word) + "!!!"):
            for text in (form, f"so {form} it is", f"a {form}", f"I {form}", f"y {form} à", f"{form} a", f"as a {form} i"):
                assert word in restored_words(text, words), text
    assert "blornak" in restored_words("b l o r n a k a g r i m p u s", words) and "grimpus" in restored_words("b l o r n a k a g r i m p u s", words)


def test_doubled_letters(tables):
    words = _Words(language_model(texts(tables[0])))
    for word in BAD:
        for k in range(len(word)):
            assert word in restored_words(f"the {word[: k + 1]}{word[k:]}, then", words)
    assert {"letters", "walks"} <= restored_words("Letters walks", words)


def test_letters_take_no_lattice_step(tables, monkeypatch):
    words, steps = _Words(language_model(texts(tables[0]))), []
    step = toxicity._step
    monkeypatch.setattr(toxicity, "_step", lambda *a: steps.append(a) or step(*a))
    restored_words("Letters wallks blloornakk, éèé ππφφ! to be or not, I a y", words)
    assert not steps
    restored_words("gr1mpus wallllks", words)
    assert steps


def test_best_reading_of_all(tables):
    model = language_model(texts(tables[0]))
    words, rng = _Words(model), random.Random(7)

    def cost(reading):
        a, b, total = SIZE - 2, SIZE - 2, 0.0
        for letter in reading:
            c = toxicity._NUMBER.get(letter, SIZE - 1)
            a, b, total = b, c, total + model[a, b, c]
        return total + model[a, b, SIZE - 2]

    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for signs in ("abelosté", "aelllossπφ", "aell01@-*") for _ in range(300)]
    for piece in ["letters", "bookkeeper", "aab", "baa", "éé", "ππφφ", *odd]:
        readings = product(*toxicity._readings(piece))
        best = min((sum(price for _, price in r) + cost("".join(x for x, _ in r)), "".join(x for x, _ in r)) for r in readings)
        assert toxicity.restore(piece, words.model) == best[1]
        if piece.isalpha():
            assert words[piece] == best[1], piece


def test_runs_of_short_pieces_are_found_whatever_the_blanks(tables):
    words, rng = _Words(language_model(texts(tables[0]))), random.Random(8)
    seen = []
    words.joined = lambda run: seen.append(" ".join(run)) or []
    long = ["letters", "walks,", "a-b-c", "(the", "x" * 50]
    short = ["a", "to", "I,", "(x", "ab!!!", "@", "é", "y" + "!" * 50]
    for _ in range(300):
        listed = [rng.choice(short if rng.random() < 0.6 else long) for _ in range(rng.randint(0, 20))]
        seen.clear()
        restored_words("".join(piece + rng.choice([" ", "  ", "\n", "\t \xa0"]) for piece in listed), words)
        marks = "".join("s" if piece in short else " " for piece in listed)
        assert [len(run.split()) for run in seen] == [len(run) for run in marks.split() if len(run) > 2]


def test_weight_is_that_of_the_best_feature():
    rng = random.Random(9)
    spell = lambda n: "".join(rng.choice("ab") for _ in range(n))
    for _ in range(50):
        evidence = {f"={spell(rng.randint(1, 9))}": rng.random() for _ in range(5)} | {f"^{spell(rng.choice(toxicity.BEGINNINGS))}": rng.random() for _ in range(8)}
        model = toxicity.ToxicityModel(np.zeros(1), evidence, toxicity.PRIOR)
        for word in (spell(rng.randint(0, 10)) for _ in range(100)):
            assert model.weight(word) == max((evidence.get(f, 0.0) for f in toxicity.features(word)), default=0.0)


def test_long_runs_of_short_pieces(tables):
    words = _Words(language_model(texts(tables[0])))
    start = time.time()
    restored_words("a b " * 5_000 + "ab\n" * 5_000 + "x! " * 5_000 + "aabbccdd" * 5_000, words)
    assert time.time() - start < 60


def test_trigrams_count_every_letter():
    counts = letter_trigrams(["Ab a", "", "日b"]).reshape(SIZE, SIZE, SIZE)
    a, b, border, other = 0, 1, SIZE - 2, SIZE - 1
    assert counts[border, border, a] == 2 and counts[border, a, b] == 1 and counts[a, b, border] == 1
    assert counts[border, border, other] == 1 and counts[border, other, b] == 1
    assert counts.sum() == 3 + 2 + 3


def test_edges(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity_scores(edge_docs, marks).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert not any(r.predicted for r in toxicity_scores(edge_docs, spark.createDataFrame([], marks.schema)).collect())
    assert toxicity_scores(no_docs, marks).count() == 0
