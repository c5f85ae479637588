"""Bounded-space online packing of token sequences into windows of fixed size.

Each task keeps at most ``open_windows`` windows. A document's tokens are cut into full windows and a rest; the rest
goes to the open window that it fills best. When it fits none, the fullest window is emitted; if that leaves more than
``slack`` places, they are filled with the head of the rest first, since documents may be cut anywhere. What is still
open at the end of a task is a leftover: leftovers of all tasks are dealt to ``groups`` tasks by the number of their
task and packed the same way, and the at most ``groups * open_windows`` windows that these leave meet in a last one.
Only leftovers carry token ids, so what moves between tasks is bounded by the number of tasks, not by the texts.

The first two rounds are written to the shared folder, so that a repeated task cannot disagree with what others read.
Missing and empty texts have just the closing id. Rows with the same or no doc_id are packed each for itself. An empty
table gives no sequences.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.bpe import PATTERN, byte_letters, pieces
from mailsieve.llm.remember import Pieces, kept
from mailsieve.plans.session import materialize

#: pieces kept
REMEMBERED = 500_000
WIDTH = 4
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# doc_id is text in the tasks: pandas would turn numbers beside a missing one into floats
_OUT = f"{PIECES}, task int, ids binary"


class LibraryIds:
    """Token ids by the tokenizers library, as bytes of little-endian 32-bit numbers. Words recur, so the ids of up to
    ``REMEMBERED`` pieces are kept; a piece is cut before a blank that a visible character follows, where no token can
    reach across. A full table is kept while it serves (``remember.Pieces``).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.blank = byte_letters()[32]
        self.cut = regex.compile(PATTERN).findall
        self.known: Pieces = Pieces(REMEMBERED)

    def _word(self, word: str) -> bytes:
        if word[1:].isalpha() and word.isascii():  # letters stand for themselves
            letters = self.blank + word[1:] if word[0] == " " else word
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(letters)
        return array("I", [t.id for t in tokens]).tobytes()

    def _new(self, piece: str) -> bytes:
        """The ids of a piece that is not remembered. A piece of several words, as lines joined by their breaks are, is
        seldom seen again; only its words are remembered."""
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            found = self._word(piece)
        else:
            marked = piece[-1] in ".,;:" and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha())
            words = [piece[:-1], piece[-1]] if marked else self.cut(piece)
            if len(words) == 1:
                found = self._word(piece)
            else:
                known = self.known
                found = b"".join([known.get(w) or self._new(w) for w in words])
                if len(words) > 2:
                    return found
        self.known.add(piece, found)
        return found

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = pieces(text)
        new = self._new
        out = list(map(self.known.get, found))
        if not all(out):
            out = [ids or new(p) for p, ids in zip(found, out)]
        self.known.looked_up(len(out))
        return b"".join(out)


def library_ids(path: str) -> LibraryIds:
    return kept(("library ids", path), lambda: LibraryIds(path))


class Packer:
    """The open windows of one task and the pieces of those that are finished."""

    def __init__(self, size: int, open_windows: int, slack: int, first_id: int):
        self.size, self.most, self.slack, self.next = size, open_windows, slack, first_id
        self.open: list[tuple[int, int]] = []  # (free places, sequence), ascending
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _finish(self, sequence: int, held: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in held:
            n = len(ids) // WIDTH
            self.done.append((doc, start, n, zlib.crc32(ids), total, sequence, at))
            at += n

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        full = self.size * WIDTH
        at = 0
        while len(ids) - at >= full:
            self._finish(self.next, [(doc, start + at // WIDTH, ids[at:at + full], total)])
            self.next += 1
            at += full
        while at < len(ids):
            need = (len(ids) - at) // WIDTH
            k = bisect.bisect_left(self.open, (need, -1))
            if k < len(self.open):
                free, sequence = self.open.pop(k)
            elif len(self.open) < self.most:
                free, sequence = self.size, self.next
                self.next += 1
                self.held[sequence] = []
            else:
                free, sequence = self.open.pop(0)
                if free <= self.slack:
                    self._finish(sequence, self.held.pop(sequence))
                    continue
            taken = min(free, need)
            self.held[sequence].append((doc, start + at // WIDTH, ids[at:at + taken * WIDTH], total))
            at += taken * WIDTH
            if free > taken:
                bisect.insort(self.open, (free - taken, sequence))
            else:
                self._finish(sequence, self.held.pop(sequence))

    def finished(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def close(self) -> None:
        for _, sequence in self.open:
            self._finish(sequence, self.held.pop(sequence))
        self.open = []


def _rows(rows: list[tuple], task: int | None = None, ids: list | None = None) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return frame.assign(task=pd.array([task] * len(rows), "Int32"), ids=ids if ids is not None else None)


def pack(docs: DataFrame, token_ids: Callable[[], Callable[[str | None], bytes]], closing: int = 0, size: int = 1024,
         open_windows: int = 64, slack: int = 4, groups: int = 64) -> DataFrame:
    """The pieces (``PIECES``, doc_id as long) of the packed texts. ``token_ids()`` gives, on the worker, the function from a text to
    its ids as bytes; ``closing`` is the id that ends every document."""
    end = closing.to_bytes(WIDTH, "little")

    def run(level: int, feed):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = TaskContext.get().partitionId()
            packer = Packer(size, open_windows, slack, level << 61 | number << 32)
            for batch in batches:
                for row in feed(batch):
                    packer.add(*row)
                    if len(packer.done) > 50_000:
                        yield _rows(packer.finished())
            if level < 2:
                left = [(d, s, None, None, t, None, None, i) for held in packer.held.values() for d, s, i, t in held]
                if left:
                    yield _rows([r[:-1] for r in left], number, [r[-1] for r in left])
            else:
                packer.close()
            yield _rows(packer.finished())
        return task

    def texts(batch: pd.DataFrame):
        coder = token_ids()
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = coder(text) + end
            yield doc, 0, ids, len(ids) // WIDTH

    def leftovers(batch: pd.DataFrame):
        for doc, start, ids, total in zip(batch["doc_id"], batch["start"], batch["ids"], batch["doc_tokens"]):
            yield doc, int(start), bytes(ids), int(total)

    columns = [c.split()[0] for c in PIECES.split(", ")]
    first = materialize(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(run(0, texts), _OUT), "packed")
    left = first.where("ids IS NOT NULL").repartition(groups, F.col("task") % groups)
    second = materialize(left.mapInPandas(run(1, leftovers), _OUT), "packed")
    last = second.where("ids IS NOT NULL").coalesce(1).mapInPandas(run(2, leftovers), _OUT)
    done = [f.where("ids IS NULL").select(*columns) for f in (first, second)]
    packed = done[0].unionByName(done[1]).unionByName(last.select(*columns))
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
