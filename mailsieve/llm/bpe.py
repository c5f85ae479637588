"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked list of symbols, and decoding
by concatenating vocabulary strings.

``Codec`` reads a vocabulary file of the tokenizers library (its path is a parameter; nothing is copied) and gives the
ids that library gives without special tokens of its own: the special strings of the file that stand in a text become
their single ids, everything else is cut by the file's kind of pattern and merged. ``coded`` applies it to whole texts.

Bounded memory: texts stream through in Arrow batches; each worker remembers the ids of the first ``REMEMBERED`` pieces
and starts afresh when too many others come, which changes speed only. Missing and empty texts have no ids and decode to an empty text.
Long words cost n log n, not n^2. Repeated rows are coded again. Columns of the input are kept under their names
except ``ids`` and ``decoded``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.remember import Pieces, kept

REMEMBERED = 500_000
#: Fixed value: the cutting pattern of byte-level vocabularies of this kind. White space is meant as Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary strings: printable bytes for themselves, the others,
    in order, for the code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Coded:
    """One text's code: ``parts`` holds, for each piece of the text, (number of ids, ids as decimals, decoded bytes)."""

    __slots__ = ("parts",)

    def __init__(self, parts: list[tuple[int, str, bytes]]):
        self.parts = parts

    @property
    def ids(self) -> list[int]:
        return [int(i) for p in self.parts for i in p[1].split(",")]

    @property
    def n_tokens(self) -> int:
        return sum([p[0] for p in self.parts])

    @property
    def decimals(self) -> str:
        return ",".join([p[1] for p in self.parts])

    @property
    def decoded(self) -> str:
        return b"".join([p[2] for p in self.parts]).decode("utf-8", "replace")


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        vocabulary, letters = known["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocabulary.items() if all(c in back for c in s)}
        self.special = {t["content"]: t["id"] for t in known["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocabulary[c] for c in letters]
        #: by left id, then right id: the rank of their merge
        self.ranks: dict[int, dict[int, int]] = {}
        self.into: list[int] = []
        for rank, pair in enumerate(known["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocabulary[a], {})[vocabulary[b]] = rank
            self.into.append(vocabulary[a + b])
        byte_of = {i: b for b, i in enumerate(self.first)}
        self.byte_ranks = {(byte_of[a], byte_of[b]): rank for a, of in self.ranks.items() if a in byte_of for b, rank in of.items() if b in byte_of}
        self.cut = regex.compile(PATTERN).findall
        self.known: Pieces = Pieces(REMEMBERED)
        alternatives = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.at_special = regex.compile(f"({alternatives})").split if alternatives else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: always the merge of lowest rank, leftmost first. A queue entry is rank * n + place; it
        is stale when the pair at that place has another rank by now."""
        first = self.first
        symbols = [first[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        rank_at = [*map(self.byte_ranks.get, zip(word, word[1:])), None]
        queue = [rank * n + i for i, rank in enumerate(rank_at) if rank is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push, ranks, none = heapq.heappop, heapq.heappush, self.ranks, {}
        while queue:
            rank, i = divmod(pop(queue), n)
            if rank_at[i] != rank:
                continue
            j = after[i]
            into = symbols[i] = self.into[rank]
            symbols[j] = -1
            rank_at[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_at[i] = ranks.get(into, none).get(symbols[k])
                if rank is not None:
                    push(queue, rank * n + i)
            else:
                rank_at[i] = None
            h = before[i]
            if h >= 0:
                rank = rank_at[h] = ranks.get(symbols[h], none).get(into)
                if rank is not None:
                    push(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def _new(self, piece: str) -> tuple[int, str, bytes]:
        """The code of a piece that is not remembered; its words are remembered too."""
        if (piece[1:] if piece[0] == " " else piece).isalpha():
            ids = self.merged(piece.encode())
            found = len(ids), ",".join(map(str, ids)), self.decode_bytes(ids)
        else:
            # most other pieces are a word and one mark
            words = [piece[:-1], piece[-1]] if piece[-1] in ".,;:" and piece[1:-1].isalpha() else self.cut(piece)
            if len(words) == 1:
                ids = self.merged(piece.encode("utf-8", "surrogatepass"))
                found = len(ids), ",".join(map(str, ids)), self.decode_bytes(ids)
            else:
                parts = Coded([self.known.get(w) or self._new(w) for w in words])
                found = parts.n_tokens, parts.decimals, b"".join([p[2] for p in parts.parts])
                if len(words) > 2:  # seldom seen again
                    return found
        self.known.add(piece, found)
        return found

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.strings[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str | None) -> Coded:
        """A word never reaches over a blank that a visible character follows, so the text is coded in pieces cut
        before such blanks, and a piece that has been seen is looked up."""
        parts: list[tuple[int, str, bytes]] = []
        known, new = self.known.get, self._new
        special = self.at_special is not None and any(s in text for s in self.special) if text else False
        for at, plain in enumerate(self.at_special(text) if special else [text] if text else []):
            if at % 2:
                i = self.special[plain]
                parts.append((1, str(i), plain.encode()))
            elif plain:
                cut = pieces(plain)
                found = list(map(known, cut))
                if not all(found):
                    found = [f or new(p) for p, f in zip(cut, found)]
                self.known.looked_up(len(found))
                parts += found
        return Coded(parts)


_before_word = regex.compile(r" (?=[^\p{White_Space}\x1c-\x1f])")


def pieces(text: str) -> list[str]:
    """The text cut before each blank that a visible character follows; a piece keeps its leading blank. A line break
    that has no white space beside it, but for the blank of the next word, is a word of its own and so a piece."""
    plain = text.isprintable() or text.replace("\n", "").isprintable()
    if "  " in text or " \n" in text or not plain and _odd_white(text):
        found = _before_word.split(text)
        found = [found[0], *[f" {p}" for p in found[1:]]]
    elif plain and "\n" in text and "\n\n" not in text and text[-1] != " ":
        found = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if "\n " in text or text[0] == "\n" or text[-1] == "\n":
            return [p for p in found if p]
    else:
        found = text.replace(" ", "\0 ").split("\0")
    return found if found[0] else found[1:]


_odd = regex.compile(r" [\p{White_Space}\x1c-\x1f]|\0| \Z")


def _odd_white(text: str) -> bool:
    return _odd.search(text) is not None


def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return kept(("codec", path), lambda: Codec(path))


def ids_and_text(code: Coded) -> tuple:
    return code.ids, code.decoded


def coded(frame: DataFrame, path: str, text: str = "text", project: Callable[[Coded], tuple] = ids_and_text,
          columns: str = "ids array<int>, decoded string") -> DataFrame:
    """The rows of ``frame`` without ``text``, with the ``columns`` that ``project`` takes from each text's code; by
    default the ids and what they decode to."""
    names = [c.split()[0] for c in columns.split(", ")]

    @F.pandas_udf(columns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for batch in batches:
            found = [project(coder.encode(t)) for t in batch]
            yield pd.DataFrame({n: [f[k] for f in found] for k, n in enumerate(names)})

    rest = [c for c in frame.columns if c not in (text, *names)]
    return frame.withColumn(text, run(F.col(text).cast("string"))).select(*rest, f"{text}.*")


def decoded(frame: DataFrame, path: str, ids: str = "ids", output: str = "text") -> DataFrame:
    """Adds the text that an array of ids decodes to; null ids give an empty text."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(path)
        for batch in batches:
            yield pd.Series([coder.decode(() if x is None else x) for x in batch], dtype="object")

    return frame.withColumn(output, run(ids))
