"""Byte-level BPE encoding and decoding over a contiguous rank array.

A word of n bytes is held as part boundaries with, beside each boundary, the rank of the merge of the two parts that
start there. The smallest rank is found by scanning the array, the boundary behind it is deleted, and the two ranks that
touch the merged part are looked up again. Words are short, so scanning a few adjacent numbers is cheaper than any
linked structure; runs beyond ``SCAN_LIMIT`` bytes take the same merges from a heap, since scans would grow with the
square of their length.

Texts are encoded some hundred at a time. The words among them that a worker doesn't remember are merged together: the
rank arrays of words of like length are the rows of one matrix, and each round takes one merge of every row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Set
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, replace_columns, slices

#: Words longer than this use the heap.
SCAN_LIMIT = 256
#: Words that a Python worker remembers, in each of two generations: as tuples of ids, and as packed ids.
CACHE_WORDS = 1 << 16
CACHE_PACKED = 1 << 16
NO_RANK = 1 << 60
#: Texts encoded together: at most so many, and no further one once they have so many characters.
GROUP_TEXTS = 1 << 10
GROUP_CHARS = 1 << 20
#: Words per matrix, the most bytes of a word in one, and the fewest words that are worth one.
MATRIX_WORDS = 1 << 11
MATRIX_BYTES = 64
MATRIX_LEAST = 24
NO_RANK32 = np.int32((1 << 31) - 1)

# Fixed value: the word pattern of the public byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the characters of Unicode's White_Space property, as a class for `re`.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Fixed value: the word pattern where all characters are ASCII, Latin letters up to U+024F (letters since Unicode 5.0) or
# common punctuation. Other characters match nothing, so a text that its matches don't cover needs the full pattern.
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = r"!-/:-@\[-`{-~\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027"
LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[{SIGNS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1 characters stand for
    themselves, all other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Generations:
    """A bounded memory in two generations: what was used since the last turn survives the next one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def put_all(self, values: dict) -> None:
        """Many at once."""
        if len(self.young) + len(values) > self.size:
            self.old, self.young = self.young, {}
        if len(values) <= self.size:
            self.young |= values
        else:
            for key, value in values.items():
                self.put(key, value)


class Codec:
    """Vocabulary, pair ranks and special tokens of one tokenizer file, with the encoded pieces seen so far."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        stand_in = byte_of_char()
        vocab = model["model"]["vocab"]
        self.bytes_of = {i: bytes(stand_in[c] for c in token) for token, i in vocab.items()}
        self.byte_id = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        #: (left id << 32 | right id) to the rank of the merge; the rank to the id that it makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = r
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: The same as arrays: all pairs in order with their ranks, the ranks of pairs of single bytes, and an id that
        #: stands for no part at the ends of a row.
        self.none = max(vocab.values()) + 1
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64(1 << 62))
        self.pair_ranks = np.append(np.fromiter(self.rank.values(), np.int32, len(self.rank))[order], NO_RANK32)
        self.made_ids = np.array(self.made, np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.byte_ranks = self.ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.word = regex.compile(WORDS)
        self.latin_word = re.compile(LATIN_WORDS)
        self.piece = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        self.words = Generations(CACHE_WORDS)
        # Ids as packed int32: one small object a word, which no garbage collection has to walk through.
        self.packed = Generations(CACHE_PACKED)
        top = max(self.bytes_of) + 1
        #: Bytes of all tokens by id, one behind the other, and decimal ids with a comma, padded with zero bytes.
        known = [self.bytes_of.get(i, b"") for i in range(top)]
        self.sizes = np.array([len(b) for b in known])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(known), np.uint8)
        self.decimals = np.array([f"{i},".encode() for i in range(top)])

    def merge(self, word: bytes) -> list[int]:
        return self.merge_scan(word) if len(word) <= SCAN_LIMIT else self.merge_heap(word)

    def merge_scan(self, word: bytes) -> list[int]:
        """``parts[i]`` is the id of the part that starts at the i-th boundary, ``ranks[i]`` the rank of merging it with
        its right neighbour; deleting a boundary deletes one entry of each."""
        rank, byte_id = self.rank, self.byte_id
        parts = [byte_id[b] for b in word]
        ranks = [rank.get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = part = self.made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 32 | part, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank.get(part << 32 | parts[i + 1], NO_RANK)
        return parts

    def merge_heap(self, word: bytes) -> list[int]:
        """The same merges in the same order (smallest rank, leftmost first), for long runs."""
        n = len(word)
        parts = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                j = after[i]
                r = self.rank.get(parts[i] << 32 | parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], NO_RANK32)

    def merge_matrix(self, words: list[bytes]) -> list[bytes]:
        """Packed ids by the merges of :meth:`merge_scan` for many words side by side, a row each.

        Parts are linked within their row, between two columns that hold no part. A merge keeps the left part's place
        and takes the right one out, so the first smallest rank of a row is always that of its leftmost pair.
        """
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes.max()) + 2
        column = np.arange(width)
        raw = np.zeros((n, width), np.int64)
        inside = (column > 0) & (column <= sizes[:, None])
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.byte_ids[raw], self.none)
        ranks = np.full((n, width), NO_RANK32)
        ranks[:, :-1] = np.where(inside[:, :-1] & inside[:, 1:], self.byte_ranks[raw[:, :-1] << 8 | raw[:, 1:]], NO_RANK32)
        cells = np.arange(n * width)
        after, before = cells + 1, cells - 1
        flat_ids, rows = ids.reshape(-1), np.arange(n)
        while len(rows):
            # Rows that are done leave the search, so that long words don't keep short ones in it.
            first = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), first]
            live = low < NO_RANK32
            if not live.all():
                rows, ranks, first, low = rows[live], ranks[live], first[live], low[live]
            here, start = rows * width + first, np.arange(len(rows)) * width - rows * width
            gone = after[here]
            behind, ahead = before[here], after[gone]
            made = self.made_ids[low]
            flat_ids[here], flat_ids[gone] = made, self.none
            after[here], before[ahead] = ahead, here
            searched = ranks.reshape(-1)
            searched[gone + start] = NO_RANK32
            searched[here + start] = self.ranks_of(made, flat_ids[ahead])
            searched[behind + start] = self.ranks_of(flat_ids[behind], made)
        left = ids != self.none
        ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
        found = ids[left].astype(np.int32).tobytes()
        return [found[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        by_size = np.argsort(sizes, kind="stable")
        fit = int((sizes <= MATRIX_BYTES).sum())
        fit = fit if fit >= MATRIX_LEAST else 0
        out: list[bytes] = [b""] * len(raw)
        for s in range(0, fit, MATRIX_WORDS):
            part = by_size[s : min(s + MATRIX_WORDS, fit)].tolist()
            for i, ids in zip(part, self.merge_matrix([raw[i] for i in part]), strict=True):
                out[i] = ids
        for i in by_size[fit:].tolist():
            out[i] = np.array(self.merge(raw[i]), np.int32).tobytes()
        return out

    def words_of(self, text: str) -> list[str]:
        found = self.latin_word.findall(text)
        return found if sum(map(len, found)) == len(text) else self.word.findall(text)

    def encode_words(self, words: Set[str]) -> dict[str, bytes]:
        """Packed ids of words that the young generation lacks; short ones are in it afterwards."""
        old = self.packed.old
        coded = {w: old[w] for w in words if w in old}
        new = list(words - coded.keys()) if coded else list(words)
        coded.update(zip(new, self.merge_all(new), strict=True))
        self.packed.put_all({w: ids for w, ids in coded.items() if len(w) <= SCAN_LIMIT})
        return coded

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a word that they share is encoded once."""
        recall = self.packed.young.get
        lacking: dict[str, str] = {}

        def plain(text: str) -> tuple[list, list]:
            """What is known of the words, and those that lack, each held once for all texts."""
            words = self.words_of(text)
            known = list(map(recall, words))
            return known, [lacking.setdefault(w, w) for w, ids in zip(words, known, strict=True) if ids is None] if None in known else []

        # Per text its plain parts, and between them the special tokens.
        parted: list[list] = []
        for text in texts:
            parts, at = [], 0
            if self.split is not None:
                for m in self.split.finditer(text):
                    parts += [plain(text[at : m.start()]), np.int32(self.special[m.group()]).tobytes()]
                    at = m.end()
            parts.append(plain(text[at:] if at else text))
            parted.append(parts)
        new = self.encode_words(lacking.keys())
        out = []
        for parts in parted:
            for i in range(0, len(parts), 2):
                known, lacked = parts[i]
                if lacked:
                    rest = iter(lacked)
                    known = [new[next(rest)] if ids is None else ids for ids in known]
                parts[i] = b"".join(known)
            out.append(np.frombuffer(b"".join(parts), np.int32))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimals[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids: Iterable[int]) -> str:
        """Unknown ids give nothing; bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        # Where each byte of the text stands among those of all tokens.
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(sizes.sum())
        return self.all_bytes[at].tobytes().decode("utf-8", "replace")


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in turn, null as empty, in groups of bounded size; a longer text is a group with those before it."""
    held: list[str] = []
    chars = 0
    for t in texts:
        held.append(t or "")
        chars += len(held[-1])
        if len(held) >= GROUP_TEXTS or chars >= GROUP_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """One codec per Python worker, kept between its tasks."""
    return Codec(spec)


def shared_spec(spark, path: str):
    """The tokenizer file, sent to the executors once: its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, path: str, column_name: str = "text", ids: str = "ids") -> DataFrame:
    """The columns of ``df`` plus ``ids`` (array of int): the tokens of the whole text, a null text as an empty one.

    Strings of special tokens in a text become their ids, as the tokenizers library does by default. An input column
    named like ``ids`` is replaced.
    """
    spec = shared_spec(df.sparkSession, path)
    plain = df.drop(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                coded = [i for group in groups(column(part, column_name).to_pylist()) for i in tool.encode_many(group)]
                yield replace_columns(part, {ids: pa.array(coded, pa.list_(pa.int32()))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, `{ids}` array<int>")


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns of ``df`` plus the decoded text; null ids give a null text."""
    spec = shared_spec(df.sparkSession, path)
    plain = df.drop(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                back = [None if i is None else tool.decode(i) for i in column(part, ids).to_pylist()]
                yield replace_columns(part, {text: pa.array(back, pa.string())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, `{text}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row ``doc_id``, ``n_tokens``, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text.

    Encodes, digests and decodes in one pass over each text, so that id arrays never leave the Python worker.
    """
    spec = shared_spec(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(spec.value)
        for batch in slices(batches, GROUP_TEXTS):
            rows = []
            for group in groups(column(batch, "text").to_pylist()):
                for ids in tool.encode_many(group):
                    listed = hashlib.sha256(tool.listed(ids)).hexdigest()
                    rows.append((len(ids), listed, hashlib.sha256(tool.decode(ids).encode()).hexdigest()))
            yield batch_of(schema, column(batch, "doc_id"), *(list(zip(*rows, strict=True)) or [[]] * 3))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary_path())
