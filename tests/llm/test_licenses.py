import random

import numpy as np
import pytest

from bindery.llm import license_texts, licenses


TEMPLATES = license_texts.templates()


def held(text, scanner):
    """License -> the most that any run of words as long as a template of it holds of that template, at every offset."""
    h = licenses.shingles(text)
    found = {}
    for k, own in enumerate(scanner.own):
        if np.isin(own, h).mean() < 0.8:
            continue
        for s in range(len(h)):
            share = float(np.isin(own, h[s : s + len(own)]).mean())
            if share >= 0.8:
                found[scanner.names[k]] = max(share, found.get(scanner.names[k], 0))
    return found


def texts(n):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(200)]
    for k in range(n):
        text, name = rng.choices(words, k=rng.randint(0, 120)), None
        if k % 3:
            name = rng.choice(sorted(TEMPLATES))
            notice = rng.choice(TEMPLATES[name]).split()
            if k % 3 == 2 and len(notice) > 20:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = notice
        yield k, " ".join(text).upper() if k % 5 == 0 else " ".join(text), name


def test_no_offset_loses_a_passage():
    """Bands over windows on a grid retrieve what trying every offset finds."""
    scanner, tried, found = licenses.Scanner(TEMPLATES), 0, 0
    for _, text, _ in texts(200):
        told = {name: share for name, share, _ in scanner.matches(text.encode())}
        for name, share in held(text.encode(), scanner).items():
            tried += 1
            found += told.get(name, 0) >= share
    assert tried > 100 and found >= 0.99 * tried


def test_scan_names_the_right_license(spark):
    rows = list(texts(300))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {}
    for r in licenses.scan(df).collect():
        found.setdefault(r["doc_id"], []).append(r["license"])
    assert not any(k in found for k, _, name in rows if name is None)
    named = [(k, name) for k, _, name in rows if name]
    assert sum(found.get(k) == [name] for k, name in named) >= 0.97 * len(named)


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_related_licenses_are_told_apart(name):
    scanner = licenses.Scanner(TEMPLATES)
    for text in TEMPLATES[name]:
        assert [r[0] for r in scanner.scan(f"some words before {text} and some behind".encode())] == [name], text


def test_two_licenses_in_one_text():
    scanner = licenses.Scanner(TEMPLATES)
    both = f"{TEMPLATES['AGPL-3.0'][0]} But parts are {TEMPLATES['GPL-2.0'][0]}"
    assert [r[0] for r in scanner.scan(both.encode())] == ["AGPL-3.0", "GPL-2.0"]


def test_strange_rows(docs):
    assert licenses.scan(docs).columns == ["doc_id", "license", "containment", "start", "end"]
    assert licenses.scan(docs).count() == 0


def test_no_templates_and_empty(docs, empty):
    assert licenses.scan(docs, {}).count() == 0
    assert licenses.scan(empty).count() == 0
