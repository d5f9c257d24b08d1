"""Byte-level BPE by batched merge rounds over flat numpy arrays."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from gaugeworks.llm.common import per_row

# The word pattern of the vocabulary, and what its library takes for white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words whose ids a task keeps; beyond it the store is emptied, which changes speed and not ids.
KEPT_WORDS = 400_000
#: Symbols that one batch of merge rounds holds, about.
BATCH_SYMBOLS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file has for each byte: bytes that print stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.piece = [b""] * self.size
        for token, i in vocab.items():
            self.piece[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        for token, i in special.items():
            self.piece[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.words = regex.compile(WORDS)
        self.special = special
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.ids: dict[str, list[int]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words at once.

        Symbols of all words lie in one array. A round looks all neighbouring pairs up
        in the sorted keys, takes the lowest rank of each word, and joins that pair
        wherever it occurs in the word, from the left. Words without a pair are done and leave.
        """
        out: list[list[int]] = [[] for _ in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        while len(sym):
            rank = np.full(len(sym), none, np.int64)
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][found] = self.ranks[at[found]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.r_[first, len(sym)])
            if (over := best == none).any():
                for f, n in zip(first[over], span[over]):
                    out[word[f]] = sym[f : f + n].tolist()
            best = np.repeat(best, span)
            live = best < none
            hit = live & (rank == best)
            # of overlapping hits (a a a), every other one from the left counts
            where = np.flatnonzero(hit)
            if len(where) > 1:
                run = np.r_[True, (np.diff(where) > 1) | (word[where[1:]] != word[where[:-1]])]
                nth = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                # hits that follow each other share a symbol only where pairs repeat one symbol
                hit[where[nth % 2 == 1]] = False
            joined = np.flatnonzero(hit)
            sym[joined] = self.made[best[joined]]
            live[joined + 1] = False
            sym, word = sym[live], word[live]
        return out

    def learn(self, words: list[str]) -> None:
        batch, held = [], 0
        for w in [*words, None]:
            if w is None or held > BATCH_SYMBOLS:
                if batch:
                    self.ids.update(zip(batch, self.merge([x.encode() for x in batch]), strict=True))
                batch, held = [], 0
            if w is not None:
                batch.append(w)
                held += len(w)

    def split(self, text: str) -> list[str]:
        """Words of ``text``; special strings are kept whole."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out = []
        for part in self.splitter.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        fresh = {w for words in split for w in words if w not in self.ids}
        if len(self.ids) + len(fresh) > KEPT_WORDS:
            self.ids = {}
            fresh = {w for words in split for w in words}
        self.ids.update({s: [i] for s, i in self.special.items()})
        self.learn(sorted(fresh - self.special.keys()))
        ids = self.ids
        return [[i for w in words for i in ids[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def forget(path: str) -> None:
    """Empties the store of words at a task's end: workers live on, and would hold it through every stage that follows."""
    if codec.cache_info().currsize:
        codec(path).ids = {}


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, ids array<int>, decoded: each text's token ids and the text that they decode to.

    Each worker reads the vocabulary at ``path``, which every machine has. Special strings in a
    text become their ids. A text of any length is encoded whole; words are shared between the texts of a task,
    so each distinct word is merged about once there. Null or empty text: no ids, decoded ''. Repeated rows and ids
    are encoded each; other columns are not read; empty input gives no rows. Lone surrogates cannot occur in Spark strings.
    """

    def f(x: dict[str, list]) -> list:
        c = codec(path)
        ids = c.encode_batch([t or "" for t in x["text"]])
        return [x["id"], ids, [c.decode(i) for i in ids]]

    kind = df.schema[id_column].dataType.simpleString()
    return per_row(df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), f"`{id_column}` {kind}, ids array<int>, decoded string", "text", f, done=lambda: forget(path))


def digests(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``encode`` with the ids and the decoded text reduced to digests where they are made."""

    def f(x: dict[str, list]) -> list:
        c = codec(path)
        ids = c.encode_batch([t or "" for t in x["text"]])
        return [
            x["id"],
            [len(i) for i in ids],
            [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids],
            [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids],
        ]

    kind = df.schema[id_column].dataType.simpleString()
    return per_row(df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", "text", f, done=lambda: forget(path))
