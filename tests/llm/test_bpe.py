import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from demandspark.llm.bpe import GROUP_CHARS, GROUP_TEXTS, Codec, Generations, decode_ids, digests, encode_texts, groups
from tests.llm.fixtures import awkward, documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


def test_random_texts(codec, library):
    rng = random.Random(3)
    pool = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "<|endoftext|>", "<|endof", "é", "\x85", "\x1c", "日本", "1", "²", "_", "!!", " ", "🙂", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character(codec, library):
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c} " for c in points[s : s + 64]) for s in range(0, len(points), 64)]
    assert [codec.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_take_the_same_merges(codec, library):
    for text in ("ab" * 3000, "the" * 500 + " " * 700 + "é" * 900, "x" * 5000, "abcabd" * 40):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
        word = text.encode()[:200]
        assert codec.merge_scan(word) == codec.merge_heap(word)


def test_queries_columns(spark, library):
    rows = awkward()
    got = sorted(map(tuple, digests(documents(spark, rows), PATH).collect()), key=str)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_and_clashes(spark):
    docs = with_clashes(documents(spark))
    out = decode_ids(encode_texts(docs, PATH), PATH)
    assert out.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    assert all((r.text or "") == r.decoded for r in out.collect())
    assert encode_texts(documents(spark, []), PATH).count() == 0
    assert digests(documents(spark, []), PATH).count() == 0


def test_memory_is_bounded():
    g = Generations(4)
    for i in range(100):
        g.put(str(i), (i,))
        assert len(g.young) <= 4 and len(g.old) <= 4
    assert g.get("99") == (99,) and g.get("1") is None


def test_words_of_a_group_are_merged_together(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        fresh = Codec(f.read())
    rng = random.Random(5)
    letters = "etaoinshr" + "éßçñ" + "日本" + "\x00\x7f"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 18))) for _ in range(40)) for _ in range(60)]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|> b", *texts[:3]]

    def one_by_one(word):
        raise AssertionError("a short word was merged on its own")

    monkeypatch.setattr(fresh, "merge_scan", one_by_one)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in fresh.encode_many(texts)] == want
    assert [i.tolist() for i in fresh.encode_many(texts)] == want  # from memory
    assert [fresh.listed(i).decode() for i in fresh.encode_many(texts)] == [",".join(map(str, ids)) for ids in want]


def test_matrix_takes_the_merges_of_the_scan(codec):
    rng = random.Random(6)
    words = [bytes(rng.choices(b"abehrt\xc3\xa9\x00 !", k=rng.randint(1, 64))) for _ in range(500)] + [b"aaaaaaaa", b"a" * 64]
    assert codec.merge_matrix(words) == [array("i", codec.merge_scan(w)).tobytes() for w in words]


def test_quick_pattern_cuts_as_the_full_one(codec):
    points = [chr(i) for i in range(0x3100)]
    for c in points:
        for text in (f"a{c} {c}1{c}{c} ", f"{c}a  {c}\t{c}!", f"'{c}'s{c}"):
            assert codec.words_of(text) == codec.word.findall(text), ascii(text)


def test_groups_hold_every_text_once():
    texts = ["x" * n for n in (0, 1, GROUP_CHARS, 5)] + [None] * (GROUP_TEXTS + 1)
    parts = list(groups(texts))
    assert [t for part in parts for t in part] == [t or "" for t in texts]
    assert max(map(len, parts)) <= GROUP_TEXTS and len(parts) == 3
    assert list(groups([])) == []


def test_memory_of_many_is_bounded():
    g = Generations(8)
    for i in range(0, 60, 3):
        g.put_all({str(n): (n,) for n in range(i, i + 3)})
        assert len(g.young) <= 8 and len(g.old) <= 8
    g.put_all({str(n): (n,) for n in range(100)})
    assert len(g.young) <= 8 and len(g.old) <= 8 and g.get("99") == (99,)


def test_decode_leaves_unknown_ids_out(codec, library):
    ids = library.encode("naïve 🙂", add_special_tokens=False).ids
    assert codec.decode([-1, *ids, 10**9]) == "naïve 🙂"
    assert codec.decode(ids[:-1]) == library.decode(ids[:-1], skip_special_tokens=False) and codec.decode([]) == ""
