"""Packing tokenized documents into windows of fixed length.

Each partition keeps a bounded number of open windows. A document's whole windows are full at once; what is left of it
goes to the open window that it fits best, and when it fits none and no further window may be opened, the fullest is
emitted. Windows still open at a partition's end are then merged over ever wider groups of partitions by the same rule.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, values, written

#: Words in each of the two generations that a task remembers.
REMEMBERED = 150_000
#: Partitions (then groups of them) whose leftovers meet in a merging task.
FAN_IN = 32


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Token ids of lower-case words as little-endian 32-bit numbers.

    The tokenizer lowers case, drops white space, and joins neither words nor a word with the comma or full stop after
    it, so a text's ids are those of such pieces one after another. Pieces of Latin letters go straight to its BPE
    model, all others through the whole tokenizer. A third of a corpus's distinct words occur once, so words are
    remembered in two generations: those met again stay, the others go when the younger one is full.

    Whether a tokenizer is such is tried on ``PROBES``. Of one that isn't, whole texts are encoded as they are.
    """

    LATIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    LETTERS = byte_letters()
    #: Pieces and the model; then case, white space of all kinds, digits, signs and other scripts between words.
    PROBES = ("stra\u00dfe, \u00e9t\u00e9. thereinafter", "Mixed CASE  and\n\ttabs ,x. Y\u00c9 don't 12 3.5 #a\r\n \u6f22\u5b57 \u0416x ")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        self.direct = self.by_word = True
        whole = [array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in self.PROBES]
        words = [p.lower().encode().split() for p in self.PROBES]
        if [b"".join(map(self.__getitem__, w)) for w in words] != whole:  # no such pieces, or another model
            self.direct = False
            self.clear()
            self.by_word = [b"".join(map(self.__getitem__, w)) for w in words] == whole
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.made(word) if ids is None else ids
        return ids

    def made(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.direct and text[-1:] in (",", ".") and self.LATIN.fullmatch(text, 0, len(text) - 1):
            return self[word[:-1]] + self[word[-1:]]
        if self.direct and self.LATIN.fullmatch(text):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.LETTERS))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: bytes | None, end: bytes) -> np.ndarray:
        """A text's ids, with ``end`` after them."""
        if not self.by_word:
            made = self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.frombuffer(array("I", made).tobytes() + end, "<u4")
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        # A special token's string has to keep its case to stay what it is.
        words = (text if b"<|" in text else text.lower()).split() if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, words)) + end, "<u4")


class Open:
    """A bounded set of open windows, ``put`` one item at a time."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.room: list[tuple[int, int]] = []  # (room left, window), by room
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """The window and the offset in it for an item of ``size``."""
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # the fullest goes
            room, window, self.made = self.length, self.made, self.made + 1
        if room > size:
            insort(self.room, (room - size, window))
        return window, self.length - room

    def left(self) -> dict[int, int]:
        """Tokens in each window that is still open."""
        return {window: self.length - room for room, window in self.room}


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, open_windows: int = 64) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for every piece of every row of ``docs``.

    ``tokenizer`` is the path of a file for the tokenizers library; it has to exist on every executor. Texts are whole,
    lower-cased by the tokenizer if it does that, by no one else (see ``WordIds``). A null or empty text is the end id
    alone. A document longer than a window fills whole windows first; only such documents are cut. Sequence ids are
    unique, not dense. Rows with equal ids are packed as documents of their own. An empty table gives no rows.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long, open boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = WordIds(tokenizer), np.array([end_id], "<u4").tobytes()
        windows, part = Open(length, open_windows), TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        full = -1  # whole windows count down

        def flush() -> pa.RecordBatch:
            rows = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "open"])
            out.clear()
            return pa.RecordBatch.from_pandas(rows, schema=SCHEMA, preserve_index=False)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for doc_id, text in zip(ids, values(texts), strict=True):
                tokens = known.of(text, end)
                for start in range(0, len(tokens), length):
                    piece = tokens[start : start + length]
                    if len(piece) == length:
                        window, offset, full = full, 0, full - 1
                    else:
                        window, offset = windows.put(len(piece))
                    out.append((doc_id, start, len(piece), zlib.crc32(piece), len(tokens), part, window, offset, False))
            # A window that has gone holds its final pieces; those still open wait for the end.
            still = windows.left()
            rows = [*out, *(r for rs in waiting.values() for r in rs)]
            waiting.clear()
            out.clear()
            for r in rows:
                if r[6] in still:
                    waiting.setdefault(r[6], []).append(r)
                else:
                    out.append(r)
            if out:
                yield flush()
        known.clear()
        known.old = {}
        release()
        out.extend((*r[:-1], True) for rs in waiting.values() for r in rs)
        if out:
            yield flush()

    SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    pieces = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(place, schema))
    merged = merge(pieces.where("open").groupBy("part", "window").agg(F.sum("length").alias("used")), length, open_windows)
    # Window numbers take the lower bits, the partition the higher; merged windows have the turn in the top bits.
    own = F.shiftleft(F.col("part").cast("long"), 36) + F.when(F.col("window") < 0, F.shiftleft(F.lit(1).cast("long"), 35) - F.col("window")).otherwise(F.col("window"))
    return pieces.join(merged, ["part", "window"], "left").select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.coalesce("sequence_id", own).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def merge(windows: DataFrame, length: int, open_windows: int) -> DataFrame:
    """``(part, window, sequence_id, base)``: where each leftover ``(part, window, used)`` goes.

    A round merges the leftovers of ``FAN_IN`` groups; what it leaves open goes to the next, until one group is left.
    A group holds at most ``FAN_IN * open_windows`` rows.
    """
    # place: the window that holds it so far, and where in it; group and slot name that window.
    state = written(windows.select("part", "window", "used", F.col("part").alias("group"), F.col("window").alias("slot"), F.lit(0).cast("long").alias("base")))
    done: list[DataFrame] = []
    groups, turn = (state.agg(F.max("group")).first()[0] or 0) + 1, 0
    schema = "group int, slot long, to_slot long, at long, open boolean"
    while True:
        turn += 1

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["used", "group", "slot"], ascending=[False, True, True])
            bins = Open(length, open_windows)
            put = [bins.put(int(n)) for n in pdf["used"]]
            still = bins.left()
            return pd.DataFrame({"group": pdf["group"].to_numpy(), "slot": pdf["slot"].to_numpy(), "to_slot": [w for w, _ in put], "at": [o for _, o in put], "open": [w in still for w, _ in put]})

        held = state.groupBy("group", "slot").agg(F.sum("used").alias("used"))
        moved = held.groupBy((F.col("group") / FAN_IN).cast("int").alias("next")).applyInPandas(run, schema)
        state = state.join(moved, ["group", "slot"]).select(
            "part", "window", "used", (F.col("group") / FAN_IN).cast("int").alias("group"), F.col("to_slot").alias("slot"), (F.col("base") + F.col("at")).alias("base"), "open"
        )
        state = written(state)
        groups = -(-groups // FAN_IN)
        over = state if groups <= 1 else state.where("not open")
        name = F.lit(turn << 60).cast("long") + F.shiftleft(F.col("group").cast("long"), 20) + F.col("slot")
        done.append(over.select("part", "window", name.alias("sequence_id"), "base"))
        if groups <= 1:
            break
        state = state.where("open").drop("open")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
