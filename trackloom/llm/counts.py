"""Operator 13: counts of a sentencepiece model's tokens, in batches balanced by bytes, without the tokens themselves.

The model is a BPE without normalisation that writes spaces as "▁" and puts one in front of each text. Its merges only make pieces of the
vocabulary, so nothing joins two characters that stand side by side in no piece: such a place is a safe boundary, and the parts of a
text cut there have, together, exactly the tokens of the whole. Before a space that follows another character there is always one (checked when a model is loaded); the
space then goes to the next part as the one that is put in front of it.

1. Rows go to Python in Arrow batches and are cut into slices of about ``SLICE`` bytes, so work and memory of a call follow bytes, not rows.
2. Each text is cut at the safe spaces. A part of more than ``PART`` characters is cut at other safe boundaries; such a part is given to the library
   behind a zero character, which no piece holds and which costs two tokens, that are taken off.
3. Equal parts of a slice are encoded once, and a worker keeps the counts of up to ``KEPT`` short parts (at most ``SHORT`` characters). Batches of about ``CALL`` bytes
   go to the library, and only lengths are kept.

A stretch without any safe boundary (one letter a million times) is encoded as one. Null and empty texts have no bytes and no tokens; repeated rows and
ties are counted each; an empty table gives an empty result. All columns of the input are kept but for the one that is set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_blocks

SLICE, PART, CALL, LIMIT = 1 << 22, 2048, 1 << 16, 4096
KEPT, SHORT = 400_000, 24
SPACE = "▁"


class Counter:
    """Counts of one model's tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        library = self.library
        special = lambda i: library.is_byte(i) or library.is_control(i) or library.is_unknown(i)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not special(i)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or library.normalize(" ") != SPACE * 2 or any("\0" in p for p in pieces):
            raise ValueError("a space within a piece, or a normalised text: parts would not have the tokens of the whole")
        self.known: dict[str, int] = {}
        self.joined = np.unique([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)])

    def cuts(self, part: str) -> list[str]:
        """A part in stretches of about PART characters, cut where no piece joins two of them."""
        code = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 32] = ord(SPACE)
        safe = np.flatnonzero(~np.isin(code[:-1] << 21 | code[1:], self.joined)) + 1
        out, at = [], 0
        while len(part) - at > PART:
            k = np.searchsorted(safe, at + PART)
            if k == len(safe):
                break
            out.append(part[at : safe[k]])
            at = int(safe[k])
        return [*out, part[at:]]

    def lengths(self, parts: list[str]) -> list[int]:
        """Tokens of each part, as a text of its own."""
        out, batch, held = [], [], 0
        for p in parts:
            batch.append(p)
            held += len(p) + 8
            if held >= CALL:
                out += map(len, self.library.encode(batch, num_threads=1))
                batch, held = [], 0
        return out + ([len(x) for x in self.library.encode(batch, num_threads=1)] if batch else [])

    def long(self, part: str) -> int:
        first, *rest = self.cuts(part)
        return sum(self.lengths([first])) + sum(n - 2 for n in self.lengths(["\0" + p for p in rest]))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        space = data == 32
        cut = np.zeros(len(data), bool)
        cut[1:-1] = space[1:-1] & ~space[:-2]
        own = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)  # the sign itself counts as a space
        cut[3:] &= ~own[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        cut[edges] = cut[edges - 1] = False  # a space that begins or ends its text stays with it
        at = np.flatnonzero(cut)
        first = offsets[:-1][np.diff(offsets) > 0]
        begin, end = np.concatenate([first, at + 1]), np.concatenate([at, offsets[1:][np.diff(offsets) > 0]])
        begin.sort()
        end.sort()
        if not len(begin):
            return np.zeros(len(offsets) - 1, np.int64)
        kept = np.delete(data, at)
        sizes = np.concatenate([[0], np.cumsum(end - begin)])
        coded = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(sizes), pa.py_buffer(kept)]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        tokens = np.zeros(len(parts), np.int64)
        if len(self.known) > KEPT:
            self.known.clear()
        seen = [self.known.get(p, -1) for p in parts]
        tokens[:] = seen
        new = [i for i, n in enumerate(seen) if n < 0]
        short = [i for i in new if len(parts[i]) <= PART]
        tokens[short] = self.lengths([parts[i] for i in short])
        self.known.update((parts[i], n) for i, n in zip(short, tokens[short].tolist(), strict=True) if len(parts[i]) <= SHORT)
        for i in (i for i in new if len(parts[i]) > PART):
            tokens[i] = self.long(parts[i])
        total = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
        return np.diff(total[np.searchsorted(begin, offsets)])


_made: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    """A model's counter in this Python worker."""
    if model not in _made:
        _made.clear()
        _made[model] = Counter(model)
    return _made[model]


def count(df: DataFrame, model: str, column: str = "text", into: str = "n_tokens") -> DataFrame:
    """``df`` with ``into``: how many tokens ``column`` has. model: path of a sentencepiece model, read by the driver and sent to the tasks (half a megabyte)."""
    with open(model, "rb") as f:
        raw = f.read()
    Counter(raw)  # a model that does not fit is an error here
    shared = df.sparkSession.sparkContext.broadcast(raw)
    names = [c for c in df.columns if c != into]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(f"`{c}`" for c in names)).schema.fields] + [f"`{into}` long"])

    def run(batches):
        counter = _counter(shared.value)
        for batch in batches:
            found = [counter.count(data, offsets) for _, _, data, offsets in text_blocks(batch, column, SLICE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], names=[*names, into])

    return df.mapInArrow(run, schema)


def digest(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of the texts."""
    counted = count(docs.select("doc_id", "text"), model)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
