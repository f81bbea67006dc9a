import hashlib
import random
import re
import time

import pytest

from convoy.llm.pii import CERTAIN, KINDS, all_spans, base_spans, candidates, examples_from, fit_field, luhn, personal_data, train_field, windows

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def by_patterns(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 1 and any(int(x) > 255 for x in m[0].split("."))) or (kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_are_the_patterns(pairs):
    rng = random.Random(2)
    parts = ["a", "b.", "@", "@c.d", "1", "22", ".", "255.", "300.", "0007.", "+", "4111111111111111", "-", " ", "(", ")", "_", "%", "é", "4", "５"]
    for text in [t or "" for _, t in pairs] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(5000)]:
        assert base_spans(text) == by_patterns(text)


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("1" * 200_000, "1 " * 100_000, "a@" * 100_000, "+1 " * 60_000, "1." * 100_000, "x" * 200_000 + "@"):
        base_spans(text)
        windows(text, [])
    assert time.time() - start < 20


@pytest.fixture(scope="module")
def field(make_prose):
    return train_field(examples_from(made(make_prose, 0, 60)))


def made(make_prose, seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        while not luhn(card):
            card = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        value = [f"ann.{i}@mail{i % 9}.example.com", f"{rng.randint(1, 99)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", card, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"][i % 4]
        out.append(f"{make_prose(seed + i, 12)} {value} {make_prose(seed + i + 1, 12)}")
    return out


def test_field_on_held_out_forms(field, make_prose):
    right = {True: [], False: []}
    for text, gold in examples_from(made(make_prose, 900, 60), seed=99):
        found = [(kind, s, e) for kind, s, e, p in field.decode(text) if p >= CERTAIN]
        right[bool(gold)].append(found == gold)
    assert sum(right[True]) / len(right[True]) >= 0.9
    assert sum(right[False]) / len(right[False]) >= 0.95


def test_marginals_are_those_of_all_segmentations(field):
    """Against enumerating every segmentation of a short window."""
    import numpy as np

    spans, found = candidates("call 555-0199 now")
    scores = field.scores(found)
    total, share = 0.0, np.zeros_like(scores)

    def walk(at, weight, used):
        nonlocal total, share
        if at == len(spans):
            total += weight
            for c, k in used:
                share[c, k] += weight
            return
        walk(at + 1, weight, used)
        for c, (i, j, _) in enumerate(found):
            if i == at:
                for k in range(len(KINDS)):
                    walk(j, weight * np.exp(scores[c, k]), [*used, (c, k)])

    walk(0, 1.0, [])
    probability, log_sum = field.marginals(len(spans), found, scores)
    assert np.isclose(np.log(total), log_sum) and np.allclose(share / total, probability)


def test_base_stays_and_added_spans_touch_none(field):
    text = "write ann.5@mail1.example.com or bob.7 (at) mail2 dot example dot com, call (212) 555-0188, on 2024-05-01"
    base, every = all_spans(text, field)
    assert set(base) <= set(every) and base == by_patterns(text)
    assert "bob.7 (at) mail2 dot example dot com" in [text[s:e] for k, s, e in every if KINDS[k] == "email"]
    assert not any("2024" in text[s:e] for _, s, e in every)
    ordered = sorted((s, e) for _, s, e in every)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_documents_and_edges(spark, documents, pairs, edge_docs, no_docs):
    found = {r.doc_id: r for r in personal_data(documents).collect()}
    assert len(found) == len(pairs)
    for i, text in pairs:
        base = by_patterns(text or "")
        r = found[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in range(4))
        listed = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))
    rows = personal_data(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.spans == "" for r in rows if r.doc_id in (2, 3, 4))
    assert personal_data(no_docs).count() == 0
    assert fit_field(no_docs.select("doc_id", "text")).weights.shape[0] == len(KINDS)
