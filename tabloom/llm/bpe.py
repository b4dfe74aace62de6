"""BPE encoding and decoding with merges found at the root of a segment tree.

The leaves of the tree hold the ranks of the pairs of adjacent symbols, the inner nodes the least (rank, place); so the root
is the leftmost pair of lowest rank. A merge changes at most three leaves, each in logarithmic time, and the word is done
when the root holds no rank. Words repeat, so a task keeps the codes of words it has met, up to a fixed number.

Defined cases: a null text is an empty one and gives no tokens; special tokens in a text become their ids, as the library
does by default; letters first assigned in Unicode 17 count as letters, which the library's older table does not have yet; rows are independent, so repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from .rows import kept, map_rows, sql_type

KEPT_WORDS = 500_000  # codes a worker keeps; beyond, it starts anew
# Fixed values of the vocabulary's format: white space, the pattern of pieces, the mark of a word's end.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a task needs of a vocabulary file; a bounded object that is sent to the tasks once."""

    tokens: list[str]
    special: dict[str, int]
    merges: list[tuple[int, int, int]]  # left, right, result; in the order of rank
    inner: list[int]
    last: list[int]
    name: str = ""
    words: dict[str, tuple[bytes, str]] = field(default_factory=dict)
    pieces: dict[str, list[int]] = field(default_factory=dict)
    pairs: list[dict[int, int]] = field(default_factory=list)  # by left symbol: right symbol -> rank
    results: list[int] = field(default_factory=list)  # by rank

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = dict(data["model"]["vocab"])
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        return cls(tokens, special, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], [ids[c] for c in byte_letters()],
                   [ids[c + WORD_END] for c in byte_letters()], path)

    def prepare(self) -> None:
        self.pairs = [{} for _ in self.tokens]
        for rank, (a, b, new) in enumerate(self.merges):
            self.pairs[a].setdefault(b, rank)
        self.results = [new for _, _, new in self.merges]
        self.piece = regex.compile(PIECES).findall
        self.split = regex.compile(rf"[^{SPACE}]+").findall
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        pairs, results, none = self.pairs, self.results, 1 << 62
        size = 1 << (n - 1).bit_length()
        place = size - 1
        bits = place.bit_length()
        tree = [none] * (2 * size)
        k = size
        left = symbols[0]
        for right in symbols[1:]:
            rank = pairs[left].get(right)
            if rank is not None:
                tree[k] = rank << bits | k - size
            k += 1
            left = right
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != none:
            i = root & place
            j, prior = after[i], before[i]
            symbols[i] = new = results[root >> bits]
            symbols[j] = -1
            after[i] = following = after[j]
            value = none
            if following < n:
                before[following] = i
                rank = pairs[new].get(symbols[following])
                if rank is not None:
                    value = rank << bits | i
            changes = ((i + size, value), (j + size, none))
            if prior >= 0:
                rank = pairs[symbols[prior]].get(new)
                changes = ((prior + size, none if rank is None else rank << bits | prior), *changes)
            for k, value in changes:
                if tree[k] == value:
                    continue
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """Codes of a text without white space, and the tokens decoded from them."""
        lower = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        ids: list[int] = []
        for piece in self.piece(lower):
            found = self.pieces.get(piece)
            if found is None:
                found = self.merge(piece.encode())
                if len(piece) <= 64:
                    self.pieces[piece] = found
            ids += found
        for words in (self.words, self.pieces):
            if len(words) >= KEPT_WORDS:
                words.clear()
        found = pack(f"<{len(ids)}I", *ids), " ".join([self.tokens[i] for i in ids])
        if len(word) <= 64:
            self.words[word] = found
        return found

    def encode_decode(self, text: str | None) -> tuple[int, bytes, str]:
        if not self.pairs:
            self.prepare()
        parts = [text or ""]
        if self.marks and any(s in parts[0] for s in self.special):
            parts = self.marks(parts[0])
        codes: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                codes.append((np.array([self.special[part]], "<u4").tobytes(), part))
            else:
                # str.split also cuts at four separators that are not white space here
                words = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else self.split(part)
                known, word = self.words, self.word
                codes.extend([known.get(w) or word(w) for w in words])
        ids = b"".join([c[0] for c in codes])
        return len(ids) // 4, ids, " ".join([c[1] for c in codes if c[0]])

    def decode(self, ids: bytes | None) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def at_work(sent) -> Vocabulary:
    """The worker's vocabulary, kept over the operator's tasks with the words it knows."""
    vocabulary = sent.value
    return kept("bpe").setdefault(vocabulary.name, vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (unsigned 32-bit integers, little end first), decoded; ``vocabulary`` is the path of the file, read by
    the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    return map_rows(docs.select(id_col, text_col), f"{id_col} {sql_type(docs, id_col)}, n_tokens long, ids binary, decoded string",
                    lambda key, text: (key, *at_work(sent).encode_decode(text)), "bpe")


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded from ids as encode_decode gives them; null ids decode to an empty text."""
    sent = coded.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    return map_rows(coded.select(id_col, ids_col), f"{id_col} {sql_type(coded, id_col)}, decoded string", lambda key, ids: (key, at_work(sent).decode(ids)), "bpe")
