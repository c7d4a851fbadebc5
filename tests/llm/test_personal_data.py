import hashlib
import random
import re

import numpy as np
import pytest

from filingforge.llm import personal_data as module
from filingforge.llm.char_tagger import Tagger, classes_of
from filingforge.llm.personal_data import KINDS, all_spans, allowed_steps, base_spans, disturb, labelled_windows, masked, personal_data

from .conftest import ODD

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and max(map(int, m[0].split("."))) > 255 or kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


CASES = [
    "", "a@b.c", "a@b@c.d.e", "@a.b@c.d", "x.y_%+-@q-1.z.w. z", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "01.002.0255.1 256.1.1.1", "4111 1111 1111 1111",
    "4111-1111-1111-1111x4111111111111111", "4 1", "+1 (974) 555-3436", "+12345678", "+1 2 3 4 5 6 7 8 9 (", "++1 234 567 890-", "é日@b.cc", "1" * 40, "9" * 3000 + ".1.1.1",
]


@pytest.mark.parametrize("text", CASES)
def test_patterns(text):
    assert base_spans(text) == plain(text)


def test_patterns_on_random_texts():
    rng = random.Random(0)
    for _ in range(4000):
        text = "".join(rng.choice("ab1902.@-_+ ()é") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "a.b" * 100_000 + "@"):
        base_spans(text)


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger(5, hidden=3, embed=2)
    tagger.w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in tagger.w.items()}
    ids, gold = rng.integers(0, 8, (3, 6)), rng.integers(0, 5, (3, 6))

    def loss():
        total = 0
        for line, tags in zip(tagger.emissions(ids).astype(np.float64), gold):
            alpha = line[0]
            score = line[0, tags[0]]
            for t in range(1, len(line)):
                alpha = line[t] + np.log(np.exp(alpha[:, None] + tagger.w["trans"]).sum(0))
                score += line[t, tags[t]] + tagger.w["trans"][tags[t - 1], tags[t]]
            total += np.log(np.exp(alpha).sum()) - score
        return total / gold.size

    gradient = tagger.gradient(ids, gold)
    for name, w in tagger.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            held, step = w[at], 1e-3
            w[at] = held + step
            high = loss()
            w[at] = held - step
            low = loss()
            w[at] = held
            assert abs((high - low) / (2 * step) - gradient[name][at]) < 2e-4, name


def test_decoding_takes_the_best_allowed_path():
    rng = np.random.default_rng(1)
    tagger = Tagger(9)
    tagger.w["trans"] = rng.normal(0, 1, (9, 9)).astype(np.float32)
    allowed = allowed_steps()
    lines = [rng.normal(0, 2, (n, 9)).astype(np.float32) for n in (1, 2, 3, 3, 2)]
    import itertools

    for line, tags in zip(lines, tagger.decode(lines, allowed)):
        best = max(
            (p for p in itertools.product(range(9), repeat=len(line)) if allowed[0, p[0]] and all(allowed[a, b] for a, b in zip(p, p[1:]))),
            key=lambda p: sum(line[t, x] for t, x in enumerate(p)) + sum(tagger.w["trans"][a, b] for a, b in zip(p, p[1:])),
        )
        assert tags.tolist() == list(best)


def private_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))


    def card():
        digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
        whole = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
        return rng.choice([" ", "-", ""]).join(whole[i : i + 4] for i in range(0, 16, 4))

    kinds = [
        lambda: f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card, lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f"version {rng.randint(1, 9)}.0", lambda: f"in {rng.randint(1900, 2030)}",
    ]
    return [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + [rng.choice(kinds)()] + [word() for _ in range(rng.randint(0, 30))])) for i in range(n)]


def test_the_tagger_learns_the_labelled_spans():
    train = [w for _, t in private_texts(300, 1) for w in labelled_windows(t)]
    tagger = Tagger(9).fit(np.stack([i for i, _ in train]), np.stack([t for _, t in train]))
    held_out = [w for _, t in private_texts(120, 2) for w in labelled_windows(t)]
    lines = tagger.emissions(np.stack([i for i, _ in held_out]))
    tags = tagger.decode(list(lines), allowed_steps())
    right = np.mean([(a > 0) == (b > 0) for (_, a), b in zip(held_out, tags)])
    assert right > 0.97
    # A form that no pattern takes, beside one that a pattern takes and that stays.
    text = "call +1 (974) 555-3436 or +1 (974)/555-3436 soon, a.1@b.example.com"
    base, every = all_spans([text], tagger)[0]
    assert base == plain(text) and set(base) <= set(every)
    assert all(a[2] <= b[1] or b[2] <= a[1] for a in every for b in every if a not in base and a != b)


def test_disturbed_spans_are_found_and_clean_texts_are_left():
    train = [w for i, t in private_texts(400, 5) for w in [*labelled_windows(t), *labelled_windows(*disturb(t, np.random.default_rng(i)))]]
    tagger = Tagger(9).fit(np.stack([i for i, _ in train]), np.stack([t for _, t in train]))
    held_out = [disturb(t, np.random.default_rng(1000 + i)) for i, t in private_texts(400, 6)]
    wanted, hit = np.zeros(4), np.zeros(4)
    for (text, spans), (base, every) in zip(held_out, all_spans([t for t, _ in held_out], tagger)):
        assert base == plain(text) and set(base) <= set(every)
        for span in spans:
            if not any(b < span[2] and span[1] < c for _, b, c in base):  # the patterns find nothing of it
                wanted[span[0]] += 1
                hit[span[0]] += span in every
    assert (wanted > 20).all() and hit.sum() / wanted.sum() > 0.8, (hit, wanted)
    rng = random.Random(9)
    clean = ["in 1998, chapter 12 (page 44) of 2,300", "ratio 3/4 at 10:30 on 2021-03-04, 5 @ 3", "version 1.2.3", "10 . 20", "call 911 or 411 (ext. 12)"]
    clean += [" ".join(rng.choice(["a", "the", "word", str(rng.randint(0, 99999)), f"{rng.randint(1, 9)}.{rng.randint(0, 99)}", "(12)"]) for _ in range(60)) for _ in range(200)]
    assert [every for base, every in all_spans(clean, tagger) if every != base] == []


def test_query_on_odd_rows(documents):
    texts = [*ODD, *((1000 + i, t) for i, t in private_texts(150, 3))]
    rows = personal_data(documents(texts)).collect()
    assert len(rows) == len(texts)
    written = sorted((repr(k), ",".join(f"{KINDS[x]}:{a}:{b}" for x, a, b in plain(t or ""))) for k, t in texts)
    assert sorted((repr(r.doc_id), r.base_sha256) for r in rows) == sorted((k, hashlib.sha256(w.encode()).hexdigest()) for k, w in written)
    spans = {r.doc_id: r.spans for r in rows}
    for key, text in texts:
        if key is not None and key >= 1000:
            assert all(f"{KINDS[x]}:{a}:{b}" in spans[key].split(",") for x, a, b in plain(text))
    assert personal_data(documents([])).collect() == []


def test_masking_leaves_clean_texts_alone(documents):
    frame = documents([*ODD, (50, "write to a.b@c.example now, 10.1.2.3"), (51, "nothing in here")])
    out = masked(frame)
    assert out.columns == frame.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[50].text == "write to <email> now, <ip>" and rows[50].n_chars == len(rows[50].text)
    assert rows[51].text == "nothing in here" and rows[1].text is None and rows[4].text == ODD[5][1]


def test_windows_cover_every_signal():
    text = "x" * 500 + "1" + "y" * 200 + "@" + "z" * 90
    stretches = module._stretches(text)
    for m in re.finditer("[0-9@]", text):
        assert any(a <= m.start() < b for a, b in stretches)
    assert len(classes_of(text)) == len(text)
    for a, b in stretches:
        covered = np.zeros(b - a, bool)
        for s in module._windows(b - a):
            covered[s : s + module.WINDOW] = True
        assert covered.all()
