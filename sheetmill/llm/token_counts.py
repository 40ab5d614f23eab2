"""Token counts of whole texts by overlap resynchronisation.

A text above ``chunk`` characters is encoded in overlapping chunks with offsets. Two neighbours are
spliced at a character position in their overlap that is a token boundary of both and is proven
stable: a blank follows a character that is not one, and no piece of the vocabulary holds such a
pair, so no merge crosses it whatever stands on the two sides. If the overlap has no such place it
is widened, at last to the end of the text. Vocabularies without that proof are encoded whole.

Inside a chunk the runs between stable places are encoded once per distinct run and worker.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; rows that repeat are
counted each; null ids stay null; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import sized_batches, strings
from sheetmill.llm.piece_units import MARK, proves_units, units

CHUNK, OVERLAP, KEPT = 16_384, 512, 400_000
_encoders: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts pieces of a sentencepiece model; keeps the counts of the runs it has seen."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.stable = proves_units(self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.chunk, self.overlap = chunk, overlap
        #: A blank at the end of a text leaves an empty run: the word mark alone.
        self.start = {"": len(self.sp.encode("x ")) - len(self.sp.encode("x"))}
        self.seen = dict(self.start)

    def runs(self, found: list[str]) -> list[int]:
        """Pieces in each run; new distinct runs are encoded in one call."""
        seen = self.seen
        if new := [u for u in set(found) if u not in seen]:
            if len(seen) + len(new) > KEPT:
                seen.clear()
                seen.update(self.start)
                new = list(set(found) - {""})
            seen.update(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        return list(map(seen.__getitem__, found))

    def chunk_boundaries(self, text: str, start: int, end: int, spliced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of ``text[start:end]`` alone: offsets of its stable token boundaries, pieces before each.

        ``spliced``: ``start`` is itself a stable place, so its blank is the mark before the rest.
        """
        found = units(text[start + spliced : end])
        counts = self.runs(found)
        # The first run carries all of its blanks, each later one lost its first blank.
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        sizes[1:] += 1
        sizes[:1] += spliced
        at = start + np.concatenate([[0], np.cumsum(sizes)])
        return at, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def spliced(self, text: str) -> int:
        """Pieces of a long text from overlapping chunks."""
        n, total, start, low = len(text), 0, 0, 0
        end = min(n, self.chunk)
        at, before = self.chunk_boundaries(text, start, end)
        base = 0  # pieces of the current chunk before ``low``, the place up to which all is counted
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(low, end - overlap)
                stop = min(n, begin + self.chunk + overlap)
                at2, before2 = self.chunk_boundaries(text, begin, stop, begin == low > 0)
                # Not a chunk's own edges: only there does cutting, not the text, make the boundary.
                common = np.intersect1d(at[(at > low) & (at < end)], at2[(at2 > begin) & (at2 < stop)])
                if len(common):
                    break
                if begin == low and stop == n:
                    common = np.array([low])
                    break
                overlap *= 2
            place = int(common[0])
            if place > low:
                total += int(before[np.searchsorted(at, place)]) - base
                base2 = int(before2[np.searchsorted(at2, place)])
            else:  # the widest overlap: the rest of the text from the last splice, as one chunk
                base2 = 0
            low, at, before, base, end = place, at2, before2, base2, stop
        return total + int(before[-1]) - base

    def count(self, text: str) -> int:
        if not self.stable:
            return len(self.sp.encode(text))
        if len(text) > self.chunk:
            return self.spliced(text.replace(MARK, " "))
        return sum(self.runs(units(text)))


def counter(model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> PieceCounter:
    key = f"{model_file}|{chunk}|{overlap}"
    if key not in _encoders:
        _encoders[key] = PieceCounter(model_file, chunk, overlap)
    return _encoders[key]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file, chunk, overlap)
        for b in sized_batches(batches):
            texts = strings(b.column("text"))
            if c.stable and (short := [t for t in texts if len(t) <= c.chunk]):
                c.runs([u for t in short for u in units(t)])  # one call for all new runs of the batch
            n = pa.array([c.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.record_batch([b.column("doc_id"), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    return count_tokens(docs, model_file).withColumn("over_limit", F.col("n_tokens") > limit)
