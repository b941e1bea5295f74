"""Packing documents into fixed-size token windows (bounded-space online packing).

Each input partition keeps a fixed number of open windows. A document goes to
the open window it fills best (least room left after it). When it fits none,
the fullest window is emitted, topped up with the head of the document (cuts
are free), and a new one opened. What stays open at the end of a partition is
merged over groups of partitions, level by level, until one group is left, so
no task sees more than a bounded number of open windows.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import cut, id_text

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_FAN_IN = 16
END_ID = 2
CACHE = 600_000  # word pieces remembered by a Python worker
SLICE = 1 << 22  # characters tokenised at once

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary, grp long")


class _Cache(dict):
    """A bounded memo: emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        out = self[key] = self.make(key)
        return out


class WordBpe:
    """Token ids of the word-end BPE file as little-endian uint32 bytes.

    The tokenizer drops white space and never joins text across it, so each
    piece between blanks is encoded once and remembered. Pieces of plain
    Latin letters are split into letter runs, single digits and symbol runs
    (the file's own split rule) and the runs go to the BPE model; any other
    piece, and special-token strings, go through the whole tokenizer.
    """

    # The split pattern of the tokenizer file and the printable
    # stand-ins of byte-level BPE (bytes 33-126, 161-172, 174-255 stand for
    # themselves, the others follow from 256 on).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        self.stand_in = [""] * 256
        for b in own:
            self.stand_in[b] = chr(b)
        for i, b in enumerate(other):
            self.stand_in[b] = chr(256 + i)
        self.split = regex.compile(self.SPLIT)
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.odd = regex.compile("[^!-~\u00a1-\u017f]").search
        self.marks = "<|" if all("<|" in x for x in self.special) else ""  # what every special string holds
        self.runs = _Cache(self._run)
        self.pieces = _Cache(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii():  # printable ASCII stands for itself
            run = "".join([self.stand_in[b] for b in run.encode()])
        return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if self.odd(piece) or (self.marks in piece and any(x in piece for x in self.special)):
            return self._whole(piece)
        piece = piece.lower()
        if piece.isalpha():  # one run of letters
            return self.runs[piece]
        return b"".join(map(self.runs.__getitem__, self.split.findall(piece)))

    def ids(self, text: str) -> bytes:
        ids_of, out, at = self.pieces.__getitem__, [], 0
        while at < len(text):  # long texts in slices cut at a blank, which changes nothing
            end = at + SLICE if len(text) - at > SLICE else len(text)
            if end < len(text):
                end = text.rfind(" ", at, end) if text.rfind(" ", at, end) > at else text.find(" ", end)
                end = len(text) if end < 0 else end
            out.append(b"".join(map(ids_of, text[at:end].replace("\n", " ").split(" "))))
            at = end
        return b"".join(out)


class Packer:
    """Bounded-space best-fit packing of pieces; full windows go to ``out``.

    A piece is ``(doc_id, start, ids bytes, doc_tokens)``.
    """

    def __init__(self, window: int, open_windows: int, next_id):
        self.window, self.most, self.next_id = window, open_windows, next_id
        self.rooms: list[tuple[int, int]] = []  # (room, serial), sorted
        self.held: dict[int, list] = {}
        self.serial = 0
        self.out: list[tuple] = []

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        while n > self.window:
            head = ids[: 4 * self.window]
            self._emit([(doc_id, start, head, total)])
            ids, start, n = ids[4 * self.window:], start + self.window, n - self.window
        if not n:
            return
        at = bisect_left(self.rooms, (n, -1))
        if at == len(self.rooms):  # fits none
            if len(self.rooms) >= self.most:
                room, key = self.rooms.pop(0)  # the fullest
                held = self.held.pop(key)
                held.append((doc_id, start, ids[: 4 * room], total))
                self._emit(held)
                ids, start, n = ids[4 * room:], start + room, n - room
            if n:
                self._keep(self.window - n, [(doc_id, start, ids, total)])
            return
        room, key = self.rooms.pop(at)  # best fit: the smallest room that takes it
        held = self.held.pop(key)
        held.append((doc_id, start, ids, total))
        self._keep(room - n, held)

    def _keep(self, room: int, held: list) -> None:
        if room == 0:
            self._emit(held)
            return
        self.serial += 1
        self.held[self.serial] = held
        insort(self.rooms, (room, self.serial))

    def _emit(self, held: list) -> None:
        seq, at = self.next_id(), 0
        for doc_id, start, ids, total in held:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, seq, at, None, None))
            at += n

    def leftovers(self, grp) -> list[tuple]:
        rows = []
        for _, key in self.rooms:
            rows += [(d, s, len(i) // 4, zlib.crc32(i), t, None, None, i, grp) for d, s, i, t in self.held[key]]
        self.rooms, self.held = [], {}
        return rows


def _columns(rows: list[tuple]) -> dict:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("ids", pa.binary()), ("grp", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID,
         fan_in: int = MERGE_FAN_IN) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Every token of every document, the closing
    ``end_id`` included, lies in exactly one piece. All sequences but the last
    of the whole table are full, so padding is less than one window in all.

    Null and empty texts hold ``end_id`` alone; a null id is kept as null;
    repeated rows are packed once each; documents longer than a window are
    cut; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    most = window

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        bpe, end = WordBpe(tokenizer_path), array("I", [end_id]).tobytes()
        count = iter(range(1 << 40))
        packer = Packer(most, open_windows, lambda: (pid << 32) + next(count))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py()
                tokens = (bpe.ids(text) if text else b"") + end
                packer.add(doc_id, 0, tokens, len(tokens) // 4)
                if len(packer.out) >= 20_000:
                    yield pa.RecordBatch.from_pydict(_columns(packer.out), schema=_ARROW)
                    packer.out = []
        rows = packer.out + packer.leftovers(pid)
        if rows:
            yield pa.RecordBatch.from_pydict(_columns(rows), schema=_ARROW)

    done = cut(id_text(docs, id_col, text_col).mapInArrow(run, PIECES))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parts = [done.where("sequence_id is not null").select(cols)]
    level, groups = 1, (done.agg(F.max("grp")).first()[0] or 0) + 1
    rest = done.where("sequence_id is null")
    while True:
        last = groups <= fan_in
        merged = _merge(rest, level, fan_in, most, last)
        merged = cut(merged)
        parts.append(merged.where("sequence_id is not null").select(cols))
        if last:
            break
        rest, groups, level = merged.where("sequence_id is null"), -(-groups // fan_in), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merge(rest: DataFrame, level: int, fan_in: int, window: int, last: bool) -> DataFrame:
    """One merge level: the open windows of ``fan_in`` groups, joined end to end."""

    def merge(key, rows: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        order = lambda r: (r["grp"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids_crc32"])
        count = iter(range(1 << 32))
        packer = Packer(window, 1, lambda: (level << 56) + (grp << 32) + next(count))
        room, held = window, []
        for r in sorted(rows.to_pylist(), key=order):
            ids, s = r["ids"], r["start"]
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room:]
                held.append((r["doc_id"], s, part, r["doc_tokens"]))
                s, room = s + len(part) // 4, room - len(part) // 4
                if not room:
                    packer._emit(held)
                    room, held = window, []
        out = packer.out
        if held and last:
            packer._emit(held)
        elif held:
            out = out + [(d, s, len(i) // 4, zlib.crc32(i), t, None, None, i, grp) for d, s, i, t in held]
        return pa.Table.from_pydict(_columns(out), schema=_ARROW)

    return (rest.withColumn("_g", F.expr(f"grp div {fan_in}"))
            .groupBy("_g").applyInArrow(lambda key, t: merge(key, t.drop_columns(["_g"])), PIECES))
