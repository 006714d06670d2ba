"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

Texts are cut at special tokens and then by the pattern of the byte-level
pre-tokenizer. Words not seen before are encoded together: their symbols lie in
one flat array; in each round every word's pair of lowest rank merges at all its
places in that word. Ranks are found by binary search over the sorted pair keys,
after the first round only for the neighbours of what merged. A word of more than
``LONG`` bytes would need about as many rounds as it has different pairs, each
over all of it; such words merge pair by pair from a heap, in the same order.
Results are kept in a table of bounded size in each worker.

Cases. Null and empty texts encode to no ids and decode to the empty text. Texts
are encoded whole, however long. Of equal ranks in a word the leftmost merges
first. Repeated rows get the same ids. An empty table gives an empty table.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.batches import bounded

#: Where the vocabulary file is on the driver; its bytes are broadcast.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of a word from which it merges by a heap.
LONG = 1000
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's table.
KEPT_WORDS = 100_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self._piece_at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self._pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self._byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self._byte_id[b] = vocab[c]
        self._size = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._pattern = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pairs: dict[int, int] | None = None
        self._forget()

    def _forget(self) -> None:
        self._handle: dict[str, int] = {}
        self._text: list[str] = []
        self._ids = np.zeros(0, np.int64)
        self._at = np.zeros(1, np.int64)

    # ---- merging

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        none = len(self._rank)
        if not none:
            return np.full(len(left), none)
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, key), none - 1)
        return np.where(self._keys[at] == key, self._rank[at], none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's start."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        flat = np.frombuffer(b"".join(b"" if len(w) > LONG else w for w in words), np.uint8)
        sym = self._byte_id[flat]
        word = np.repeat(np.arange(len(words)), [0 if len(w) > LONG else len(w) for w in words])
        done_sym = [self._merge_long(words[i]) for i in long]
        done_word = [np.full(len(s), i) for i, s in zip(long, done_sym, strict=True)]
        none = len(self._rank)
        rank = np.full(len(sym), none)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.concatenate((start, [len(word)]))))
            hit = (rank == least) & (least < none)
            # Places of one pair that overlap (a symbol with itself) merge from the left: every other one of a run.
            place = np.flatnonzero(hit)
            if len(place) > 1 and (place[1:] == place[:-1] + 1).any():
                run = np.concatenate(([True], place[1:] != place[:-1] + 1))
                first = place[run][np.cumsum(run) - 1]
                place = place[(place - first) % 2 == 0]
            ended = least == none
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
            sym[place] = self._made[rank[place]]
            left = ~ended
            left[place + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[place] = True
            sym, word, rank, changed = sym[left], word[left], rank[left], changed[left]
            # Pairs that begin with what was made, and those that end with it.
            new = changed.copy()
            new[:-1] |= changed[1:]
            at = np.flatnonzero(new)
            rank[at] = none
            at = at[at < len(sym) - 1]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._ranks(sym[at], sym[at + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: its pairs in a heap by rank and place, its symbols in a linked list."""
        if self._pairs is None:
            self._pairs = dict(zip(self._keys.tolist(), self._rank.tolist(), strict=True))
        pairs, made, size = self._pairs, self._made.tolist(), self._size
        first = self._byte_id[np.frombuffer(word, np.uint8)]
        rank = self._ranks(first[:-1], first[1:])
        at = np.flatnonzero(rank < len(self._rank))
        heap = list(zip(rank[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        sym, n = first.tolist(), len(first)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or pairs.get(sym[i] * size + sym[j]) != r:
                continue  # one of the two has merged since
            sym[i], sym[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(sym[i] * size + sym[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pairs.get(sym[h] * size + sym[i])) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([s for s in sym if s >= 0], np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self._handle) + len(words) > KEPT_WORDS:
            self._forget()
        new = [w for w in words if w not in self._handle]
        if not new:
            return
        special = [w for w in new if w in self.special]
        plain = [w for w in new if w not in self.special]
        ids, at = self.merge([w.encode() for w in plain])
        for words_, ids_, at_ in ((plain, ids, at), (special, np.array([self.special[w] for w in special], np.int64), np.arange(len(special) + 1))):
            base = len(self._text)
            self._handle.update(zip(words_, range(base, base + len(words_)), strict=True))
            shown = list(map(str, ids_.tolist()))
            self._text += [",".join(shown[i:j]) for i, j in zip(at_[:-1].tolist(), at_[1:].tolist(), strict=True)]
            self._at = np.concatenate((self._at, len(self._ids) + at_[1:]))
            self._ids = np.concatenate((self._ids, ids_))

    # ---- texts

    def _words(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._pattern.findall(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [*self._pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._pattern.findall(text[at:])

    def _handles(self, texts: list[str]) -> list[np.ndarray | list[int]]:
        cut = [self._words(t) for t in texts]
        words: set[str] = set()
        for c in cut:
            words.update(c)
        self._learn(words)
        return [list(map(self._handle.__getitem__, c)) for c in cut]

    def _gather(self, handles: list[int]) -> np.ndarray:
        h = np.array(handles, np.int64)
        count = self._at[h + 1] - self._at[h]
        shift = np.repeat(self._at[h] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return self._ids[np.arange(len(shift)) + shift]

    def groups(self, texts: Iterable[str]) -> Iterator[list[str]]:
        """Runs of texts of some 400,000 characters; only so many words are held at once."""
        own, size = [], 0
        for t in texts:
            own.append(t)
            size += len(t)
            if size > 400_000:
                yield own
                own, size = [], 0
        if own:
            yield own

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        return [self._gather(h).astype(np.int32) if h else np.zeros(0, np.int32) for g in self.groups(texts) for h in self._handles(g)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        at = self._piece_at[ids]
        count = self._piece_at[ids + 1] - at
        shift = np.repeat(at - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return self._pieces[np.arange(len(shift)) + shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode_shown(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids, and the ids in decimal joined by commas, of each text."""
        for g in self.groups(texts):
            for h in self._handles(g):
                yield (self._gather(h), ",".join(map(self._text.__getitem__, h))) if h else (np.zeros(0, np.int64), "")


_loaded: dict[bytes, ByteBPE] = {}


def tokenizer(definition: bytes) -> ByteBPE:
    """One tokenizer a worker."""
    key = hashlib.sha256(definition).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(definition)
    return _loaded[key]


def encoder(spark: SparkSession, path: str = TOKENIZER):
    """A Column function: text to its ids."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        t = tokenizer(shared.value)
        return pa.array(t.encode(v.as_py() or "" for v in texts), pa.list_(pa.int32()))

    return encode


def decoder(spark: SparkSession, path: str = TOKENIZER):
    """A Column function: ids to their text. Null ids decode to the empty text."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        t = tokenizer(shared.value)
        return pa.array([t.decode(np.array(v or [], np.int64)) for v in ids.to_pylist()], pa.string())

    return decode


def codec(spark: SparkSession, path: str = TOKENIZER):
    """A Column function: text to its ids, and whether they decode to it."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])

    @F.arrow_udf("ids array<int>, exact boolean")
    def both(texts: pa.Array) -> pa.Array:
        t = tokenizer(shared.value)
        given = [v.as_py() or "" for v in texts]
        ids = t.encode(given)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode_bytes(i) == g.encode() for i, g in zip(ids, given, strict=True)], pa.bool_())], fields=list(kind))

    return both


def counter(spark: SparkSession, path: str = TOKENIZER):
    """A Column function: text to how many ids it has."""
    encode = encoder(spark, path)
    return lambda text: F.size(encode(text)).cast("long")


def digests(docs: DataFrame, path: str = TOKENIZER, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        t = tokenizer(shared.value)
        rows = []
        for ids, shown in t.encode_shown(v.as_py() or "" for v in texts):
            back = t.decode(ids).encode()
            rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), r, strict=True)) for r in rows], kind)

    out = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
