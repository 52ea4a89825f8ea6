import random
import re

import pytest

from demandspark.llm.licences import BASE_PHRASES, TEMPLATES, Index, read_templates, scan_licences, words_of
from tests.llm.fixtures import awkward, documents, with_clashes


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        ws = phrase.split()
        for i in range(len(words) - len(ws) + 1):
            if words[i : i + len(ws)] == ws:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(spark, rows):
    got = scan_licences(documents(spark, rows)).collect()
    base = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert base == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    return {r.doc_id: r for r in got}


def test_base_places(spark):
    texts = ["MIT License mit-license; mit. LICENSE", "the general public license general public general public license", "licensemit license", "apache\nlicense apache license" * 50]
    check(spark, awkward() + [(1000 + i, t, None, None, None) for i, t in enumerate(texts)])


def test_templates_are_found_at_their_place(spark):
    filler = " ".join(f"word{i}" for i in range(500))
    rows = [(i, f"{filler}\n// {t.text}\n{filler}", None, None, None) for i, t in enumerate(TEMPLATES)]
    scattered = " ".join(w + " " + filler for w in TEMPLATES[0].text.split())
    rows += [(100, scattered, None, None, None), (101, filler, None, None, None)]
    got = check(spark, rows)
    for i, t in enumerate(TEMPLATES):
        assert t.label in got[i].labels.split(","), t.label
        assert got[i].score > 0.9
    assert got[100].labels == got[101].labels == ""


def test_key_phrases_are_mandatory(spark):
    t = next(t for t in TEMPLATES if t.label == "bsd")
    rows = [(1, t.text.replace("binary", "other"), None, None, None), (2, t.text, None, None, None)]
    got = check(spark, rows)
    assert (got[1].labels, got[2].labels) == ("", "bsd")


def test_empty_and_clashes(spark):
    assert scan_licences(documents(spark, [])).count() == 0
    assert scan_licences(with_clashes(documents(spark))).count() == len(awkward())


def test_templates_do_not_crowd_each_other_out(spark):
    filler = " ".join(f"word{i}" for i in range(50))
    words = sorted({w for t in TEMPLATES for w in re.findall("[a-z0-9]+", t.text.lower())})
    together = f"\n{filler}\n".join(t.text for t in TEMPLATES)
    scattered = " ".join(f"{w} {filler}" for w in words)
    rows = [(1, together, None, None, None)] + [(2 + i, f"{scattered}\n{t.text}\n{scattered}", None, None, None) for i, t in enumerate(TEMPLATES)]
    rows += [(100 + i, filler, None, None, None) for i in range(30)]
    got = check(spark, rows)
    assert {t.label for t in TEMPLATES} <= set(got[1].labels.split(","))
    for i, t in enumerate(TEMPLATES):
        assert t.label in got[2 + i].labels.split(",") and got[2 + i].score > 0.9, t.label
    short = "\n".join([TEMPLATES[0].text, filler, "Licensed under the Apache License, Version 2.0"])
    assert "apache-2.0" in check(spark, [(1, short, None, None, None)])[1].labels.split(",")


def brute_labels(text):
    """Templates whose mandatory phrases all stand within a window around one position, tried at every position."""
    words, found = words_of(text.encode()), set()

    def starts(phrase, ws):
        p = words_of(phrase.encode())
        return [i for i in range(len(ws)) if ws[i : i + len(p)] == p]

    for t in TEMPLATES:
        own = words_of(t.text.encode())
        offsets = [{s - starts(m, own)[0] for s in starts(m, words)} for m in t.mandatory]
        if all(any(any(abs(o - x) <= 8 for x in other) for other in offsets[1:]) or len(offsets) == 1 for o in offsets[0]) and offsets[0]:
            found.add(t.label)
    return found


def damaged(n):
    rng = random.Random(5)
    vocab = sorted({w for t in TEMPLATES for w in t.text.split()})
    for _ in range(n):
        parts = []
        for t in rng.sample(TEMPLATES, rng.randint(0, 4)):
            ws = t.text.split()
            lost = rng.randrange(len(ws) + 1) if rng.random() < 0.5 else None
            parts.append(" ".join(w for i, w in enumerate(ws) if i != lost))
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(30, 200))))
        yield "\n".join(parts)


def test_lookup_finds_what_trying_every_position_does():
    index = Index(BASE_PHRASES, TEMPLATES, {}, 100)
    for text in damaged(150):
        got = set(filter(None, index.scan(text.encode())[5].split(",")))
        assert brute_labels(text) <= got


@pytest.mark.parametrize("t", TEMPLATES, ids=lambda t: t.label)
def test_only_the_lookup_proposes_templates(t):
    index = Index(BASE_PHRASES, TEMPLATES, {}, 100)
    assert t.label in index.scan(t.text.encode())[5].split(",")
    index.postings = {}
    assert t.label not in index.scan(t.text.encode())[5].split(",")


def test_whole_texts_from_a_folder(spark, tmp_path):
    body = " ".join(f"clause{i}" for i in range(400))
    for name in ("First-1.0", "Second-2.0"):
        (tmp_path / name).write_text(f"The {name} Public Terms of Use, as of May\n{body} {name}")
    (tmp_path / "empty").write_text("")
    made = read_templates(tmp_path)
    assert [t.label for t in made] == ["first-1.0", "second-2.0"]
    whole, half = made[0].text, made[1].text[: len(made[1].text) // 2]
    rows = [(1, f"before {whole} after", None, None, None), (2, half, None, None, None), (3, body, None, None, None)]
    rows += [(10 + i, "other words", None, None, None) for i in range(50)]  # what all documents hold has no weight
    got = {r.doc_id: r for r in scan_licences(documents(spark, rows), templates=made).collect()}
    assert [got[i].labels for i in (1, 2, 3)] == ["first-1.0", "second-2.0", ""]
    assert got[1].covered > 0.99 and 0.2 < got[2].covered < 0.8 and got[3].covered == 0
