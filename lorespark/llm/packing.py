"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each scan task packs its own documents in their order, so nothing is shuffled and a repeated task gives the same
pieces. A document longer than a window is cut into whole windows and a rest. A rest goes to the fill level (0: a new
window) that leaves the sum of squared counts of partially filled windows smallest; the counts are kept in one array
with a place per level. When a task ends, its partially filled windows are closed by cutting: pieces of the emptiest
windows fill the fullest, so at most one window per task stays partial, and a window whose fill is a power of two is
left as it is.

Ids are those that ``tokenizers`` gives for the named public vocabulary, special tokens spelt out in a text included,
then the end id. The same ranks are run by the faster of the two libraries; texts that spell out a special token, or
hold stretches of more than ``LONG`` characters of one kind, by ``tokenizers`` itself. Both give the same ids.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import spread

WINDOW = 2048
END = 1
LONG = 2000
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str) -> Callable[[str], list[int]]:
    """Ids of a text under a byte-level BPE file; ``path`` names the ``.json`` file, ranks of the same name speed it up."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    slow = lambda t: whole.encode(t, add_special_tokens=False).ids
    try:
        import public_tokenizers
        import tiktoken

        lines = open(re.sub(r"\.json$", ".tiktoken", path), "rb").read().split(b"\n")
    except (ImportError, FileNotFoundError):
        return slow
    ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in lines if line)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [x.content for x in whole.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
    stretch = re.compile(r"\S{%d}|\s{%d}" % (LONG, LONG))
    return lambda t: slow(t) if special.search(t) or len(t) >= LONG and stretch.search(t) else fast(t)


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class SumOfSquares:
    """Open windows by fill level; windows are lists of pieces ``(key, start, length)``."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def place(self, key: object, start: int, size: int) -> list[tuple] | None:
        """Put a piece of at most a window; returns the window's pieces if it is full now.

        Moving a window from level h to h + s changes the sum of squares by 2 * (N(h+s) - N(h)) + 2, where full and
        new windows don't count; ties go to the fullest level.
        """
        if size == self.window:
            return [(key, start, size)]
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        best, cost = 0, 2 * int(self.count[size]) + 1
        if len(levels):
            change = 2 * (self.count[levels + size] - self.count[levels]) + 2
            if levels[-1] + size == self.window:
                change[-1] = 1 - 2 * int(self.count[levels[-1]])
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = int(levels[k])
        pieces = self.open[best].pop() if best else []
        self.count[best] -= bool(best)
        pieces.append((key, start, size))
        if best + size == self.window:
            return pieces
        self.open[best + size].append(pieces)
        self.count[best + size] += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """Empty the level array: the fullest windows are topped up with cuts from the emptiest."""
        rest = [(h, w) for h in range(1, self.window) for w in self.open[h]]
        self.__init__(self.window)
        lo, hi = 0, len(rest) - 1
        give: list[tuple] = []
        while hi >= lo:
            fill, pieces = rest[hi]
            hi -= 1
            while fill < self.window and (give or lo <= hi):
                if not give:
                    give = rest[lo][1][::-1]
                    lo += 1
                key, start, size = give.pop()
                take = min(size, self.window - fill)
                pieces.append((key, start, take))
                fill += take
                if take < size:
                    give.append((key, start + take, size - take))
            yield pieces
        while give:
            pieces, fill = [], 0
            while give and fill < self.window:
                key, start, size = give.pop()
                take = min(size, self.window - fill)
                pieces.append((key, start, take))
                fill += take
                if take < size:
                    give.append((key, start + take, size - take))
            yield pieces


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece of every document, with the columns of ``OUT``. No shuffle."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path)
        base = TaskContext.get().partitionId() << 40
        packer, row, seq = SumOfSquares(window), 0, 0
        # ids of documents with pieces in open windows; pieces point at them
        held: list[tuple[list[tuple], int]] = []
        pending = 0
        names = [x.split(" ")[0] for x in OUT.split(", ")]

        def emit() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for pieces, number in held:
                offset = 0
                for (doc_id, ids, total), start, size in pieces:
                    data = ids[start : start + size]
                    for c, v in zip(cols, (doc_id, start, size, zlib.crc32(data), total, number, offset)):
                        c.append(v)
                    offset += size
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        def full(pieces: list[tuple]) -> None:
            nonlocal seq, pending
            held.append((pieces, base + seq))
            seq += 1
            pending += len(pieces)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) if text else []
                ids.append(end)
                total = len(ids)
                key = (doc_id, np.array(ids, "<u4"), total)
                row += 1
                at = 0
                while total - at >= window:
                    full([(key, at, window)])
                    at += window
                if at < total:
                    if at:  # an open window keeps alive only what it needs
                        key = (doc_id, _Tail(key[1][at:].copy(), at), total)
                    done = packer.place(key, at, total - at)
                    if done:
                        full(done)
                if pending >= 4096:
                    yield emit()
                    pending = 0
        for pieces in packer.close():
            full(pieces)
        if held:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


class _Tail:
    """The last ids of a document, sliced by their places in the whole document."""

    def __init__(self, ids: np.ndarray, first: int):
        self.ids, self.first = ids, first

    def __getitem__(self, s: slice) -> np.ndarray:
        return self.ids[s.start - self.first : s.stop - self.first]


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document packed into windows of 2048 tokens."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
