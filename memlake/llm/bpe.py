"""Byte-pair encoding and decoding of whole texts.

A word's symbols stand in a doubly linked list; a heap of (merge rank, place) gives the next merge; an entry whose pair is
no longer there is stale and is skipped. Decoding puts vocabulary strings together. The vocabulary, merges and added tokens
come from a tokenizer's JSON file. So do normalizer and pre-tokenizer: a chunk with characters that Unicode's versions may
treat differently (see chunks.settled) goes through the file's own.

Null texts are read as empty: 0 tokens. Ids may be null or repeat: one row out for each row in.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import chunks
from memlake.llm.common import over_texts

#: Bytes of pieces and what they give that a task holds at once.
CACHE_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next letter from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder for one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.lower = bool(spec["normalizer"])
        self.pattern = regex.compile(chunks.split_pattern(spec))
        self.words_of = chunks.words_of(path)
        self.joins = "" if spec["decoder"] else " "
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.cache = chunks.Cache(self._chunks, CACHE_BYTES, lambda x: 160 + len(x[1]) + len(x[2]))
        self.path, self.own = path, None

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        sym = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        sym = [s for s in sym if s is not None]
        n, merges = len(sym), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if sym[i] is None or (j := after[i]) >= n:
                continue
            m = merges.get((sym[i], sym[j]))
            if m is None or m[0] != rank:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = m[1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((sym[i], sym[k])):
                    heapq.heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := merges.get((sym[h], sym[i]))):
                heapq.heappush(heap, (m[0], h))
        return [s for s in sym if s is not None]

    def _words(self, chunk: str) -> list[bytes]:
        """A chunk's pre-tokens; one that isn't settled is cut by the file's own normalizer and pre-tokenizer."""
        if chunks.settled(chunk):
            return [w.encode() for w in self.pattern.findall(chunk)]
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        if self.lower:
            chunk = self.own.normalizer.normalize_str(chunk)
        return [bytes(map(self.bytes_of.__getitem__, piece)) for piece, _ in self.own.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunks(self, missing: list[str]) -> list[tuple[int, str, str]]:
        out = []
        for chunk in missing:
            ids = [i for w in self._words(chunk) for i in self.merge(w)]
            out.append((len(ids), " ".join(map(str, ids)), self.joins.join(self.names[i] for i in ids)))
        return out

    def _plain(self, text: str) -> list[str]:
        cut = self.words_of(text)
        return [text] if cut is None else cut

    def parts(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its pieces' numbers of ids, ids as text, and vocabulary strings put together."""
        cut: list[list[str]] = []
        added: set[int] = set()
        for i, t in enumerate(texts):
            if self.special and self.special.search(t):
                added.add(i)
                cut.append([x for piece in self.special.split(t) for x in ([piece] if piece in self.added else self._plain(piece))])
            else:
                cut.append(self._plain(t))
        get = self.cache.load({c for row in cut for c in row}.difference(self.added))
        one = {s: (1, str(i), s) for s, i in self.added.items()}
        return [[x for c in row if (x := (one.get(c) or get(c)) if i in added else get(c))[0]] for i, row in enumerate(cut)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts([text])[0] for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings put together; with a byte-level decoder their letters become bytes again."""
        return self.read(self.joins.join(self.names[i] for i in ids))

    def read(self, strings: str) -> str:
        if self.joins:
            return strings
        out = bytearray()
        for c in strings:
            out += bytes([self.bytes_of[c]]) if c in self.bytes_of else c.encode("utf-8", "surrogatepass")
        return out.decode("utf-8", "replace")


def _coder(path: str):
    def make():
        own = Codec(path)

        def run(x: dict) -> dict:
            out: dict = {"_key": x["_key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for row in own.parts(x["_text"]):
                n, ids, strings = zip(*row, strict=True) if row else ((), (), ())
                out["n_tokens"].append(sum(n))
                out["ids_sha256"].append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.read(own.joins.join(strings)).encode("utf-8", "surrogatepass")).hexdigest())
            return out

        return run

    return make


def _ids(path: str):
    def make():
        own = Codec(path)
        return lambda x: {"_key": x["_key"], "ids": [[int(i) for _, ids, _ in row for i in ids.split(" ")] for row in own.parts(x["_text"])]}

    return make


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids: the token ids of every whole text."""
    return over_texts(_texts(docs, text, key), _ids(tokenizer_path), "_key bigint, ids array<int>").withColumnRenamed("_key", key)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, text: what the ids read."""

    def make():
        own = Codec(tokenizer_path)
        return lambda x: {"_key": x["_key"], "text": [own.decode(i) for i in x["_ids"]]}

    rows = encoded.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    return over_texts(rows, make, "_key bigint, text string").withColumnRenamed("_key", key)


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded."""
    schema = "_key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return over_texts(_texts(docs, text, key), _coder(tokenizer_path), schema).withColumnRenamed("_key", key)
