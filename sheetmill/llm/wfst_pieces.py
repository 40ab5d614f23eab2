"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blank to word mark, a word mark
before the text), the pieces (a trie whose final states put out a piece) and the byte fallback (a
character that no piece holds puts out one piece for each of its bytes). Composed with an input
they give a lattice over its positions; the ids are read off its shortest path in the tropical
semiring.

For byte-pair models the path weights are 0 and infinity: an arc may follow another only where
merging the two pieces' characters, side by side, gives back just these two pieces (kept for each
pair of pieces once it is known). Exactly one path then has a finite weight, and it is the
byte-pair encoding. For unigram models the weight of an arc is minus the piece's score.

Word marks that stand in runs have pieces of one and the same score, which the pairwise rule cannot
order; runs of blanks are therefore merged in order of score and place instead.

Defined results: a null text is empty; the empty text has no pieces and decodes to itself; a word
mark in a text is encoded as a blank (as the format does), so such a text does not decode to
itself and has ``round_trip`` false; repeated rows give repeated results; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from sheetmill.llm.common import sized_batches, strings, tidied
from sheetmill.llm.piece_units import MARK, proves_units, units

KEPT = 150_000
_LETTERS, _RUNS = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+|[\W\d_]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_machines: dict[str, "PieceTransducer"] = {}


class PieceTransducer:
    """The compiled machines of one model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser and escaped blanks are compiled")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are compiled")
        self.bpe, self.prefix = model.trainer_spec.model_type == BPE, spec.add_dummy_prefix
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.score = [p.score for p in model.pieces]
        self.worst = min(self.score) - 10.0  # of a character without a piece, in unigram models
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in model.pieces
        ]
        #: The trie: a state is a dict from a character to a state; "" gives the piece of a final state.
        self.trie: dict = {}
        for piece, i in self.id_of.items():
            state = self.trie
            for ch in piece:
                state = state.setdefault(ch, {})
            state[""] = i
        self.stable = proves_units(self.id_of)
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.allowed: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        letter = lambda ch: bool(_LETTERS.match(ch))
        #: No piece joins a letter to another sign (but a word mark before it): places between them are stable too.
        self.apart = self.stable and all(a == MARK or letter(a) == letter(b) for piece in self.id_of for a, b in zip(piece, piece[1:]))

    # -- the normaliser and the byte fallback ------------------------------------------------
    def fallback(self, ch: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in ch.encode("utf-8", "surrogatepass")]

    # -- byte-pair order ----------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """Symbols after all merges, the best score first and the leftmost of equals."""
        sym: list[str | None] = list(text)
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id_of.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, sym[a] + sym[b]))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = right[a] if sym[a] is not None else -1
            if b < 0 or sym[a] + sym[b] != whole:
                continue
            sym[a], sym[b], right[a] = whole, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in sym if s is not None]

    def follows(self, a: int, b: int) -> bool:
        """True if the characters of pieces ``a`` and ``b``, side by side, merge to just these two."""
        key = a * 1_000_003 + b
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > 500_000:
                self.allowed.clear()
            known = self.allowed[key] = self.merged(self.text_of[a] + self.text_of[b]) == [self.text_of[a], self.text_of[b]]
        return known

    # -- composition and shortest path ---------------------------------------------------------
    def arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """The lattice's arcs from position ``i``, short ones first: where each ends, its piece."""
        out, state, j, n = [], self.trie, i, len(text)
        while j < n and (state := state.get(text[j])) is not None:
            j += 1
            if "" in state:
                out.append((j, state[""]))
        return out

    def zero_path(self, text: str) -> list[int]:
        """The only path of weight 0, for byte-pair models.

        Every finite weight is 0, so the search need not order its open positions by cost: it goes
        on along the longest arc of weight 0 and leaves a position from which none leads on. What
        leads to a position along such arcs is the encoding of the text before it, of which there
        is one; so a position once left is never entered again.
        """
        n, i, before = len(text), 0, -1
        path: list[tuple[int, int]] = []
        stack: list[tuple[int, int, list[tuple[int, int]]]] = []
        dead, allowed = bytearray(n + 1), self.allowed
        options = self.arcs(text, 0)
        if not options or options[0][0] > 1:
            options.insert(0, (1, -1))
        while i < n:
            while options:
                j, piece = options.pop()
                if dead[j]:
                    continue
                if before >= 0 and piece >= 0:
                    ok = allowed.get(before * 1_000_003 + piece)
                    if not (self.follows(before, piece) if ok is None else ok):
                        continue
                stack.append((i, before, options))
                path.append((i, piece))
                i, before = j, piece
                options = self.arcs(text, i)
                if i < n and (not options or options[0][0] > i + 1):
                    options.insert(0, (i + 1, -1))
                break
            else:
                dead[i] = 1
                i, before, options = stack.pop()
                path.pop()
        return [x for at, piece in path for x in ([piece] if piece >= 0 else self.fallback(text[at]))]

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the lattice of a normalised text."""
        n = len(text)
        if self.bpe and MARK * 2 in text:
            return [i for s in self.merged(text) for i in ([self.id_of[s]] if s in self.id_of else self.fallback(s))]
        if self.bpe:
            return self.zero_path(text)
        cost: list[float] = [0.0] + [float("inf")] * n
        came: list[tuple[int, int]] = [(-1, -1)] * (n + 1)  # from which position, with which piece (-1: bytes)
        for i in range(n):
            here, single = cost[i], False
            for j, piece in self.arcs(text, i):
                single = single or j == i + 1
                if here - self.score[piece] < cost[j]:
                    cost[j], came[j] = here - self.score[piece], (i, piece)
            if not single and here - self.worst < cost[i + 1]:
                cost[i + 1], came[i + 1] = here - self.worst, (i, -1)
        path: list[int] = []
        at = n
        while at > 0:
            start, piece = came[at]
            path += [piece] if piece >= 0 else self.fallback(text[start])[::-1]
            at = start
        return path[::-1]

    def unit(self, text: str, first: bool = False) -> list[int]:
        return self.shortest((MARK if self.prefix or not first else "") + text.replace(" ", MARK))

    def packed_unit(self, text: str, kind: str) -> bytes:
        """Of a run of blanks with its word: each run of letters and of other signs on its own, where that is proven."""
        if not self.apart or text.isalpha() or " " in text or not text:
            return np.array(self.unit(text), dtype=kind).tobytes()
        out, seen = [], self.seen
        for k, run in enumerate(_RUNS.findall(text)):
            key = run if k == 0 else MARK + run  # no text holds a word mark here, so this key is free
            if (got := seen.get(key)) is None:
                got = seen[key] = np.array(self.unit(run) if k == 0 else self.shortest(run), dtype=kind).tobytes()
            out.append(got)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers (32-bit for vocabularies above 65,536)."""
        kind = "<u2" if len(self.surface) <= 65_536 else "<u4"
        if not text:
            return b""
        if not self.stable or not self.prefix:
            return np.array(self.unit(text, first=True), dtype=kind).tobytes()
        seen, found = self.seen, units(text)
        try:
            return b"".join([seen[u] for u in found])
        except KeyError:
            if len(seen) > KEPT:
                seen.clear()
            for u in found:
                if u not in seen:
                    seen[u] = self.packed_unit(u, kind)
            return b"".join([seen[u] for u in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u2" if len(self.surface) <= 65_536 else "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: surfaces in a row, less the blank that the normaliser put before it."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw[self.prefix and raw[:1] == b" " :].decode("utf-8", "surrogatepass")


def machine(model_file: str) -> PieceTransducer:
    if model_file not in _machines:
        _machines[model_file] = PieceTransducer(model_file)
    return _machines[model_file]


def clear() -> None:
    """Empties what the machines of a worker have learned from texts."""
    for m in _machines.values():
        m.seen.clear()


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, ids (array<int>), decoded``: the ids of each text and what they decode to."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_file)
        for b in sized_batches(batches, most=2 << 20):
            texts = strings(b.column("text"))
            ids = [m.encode(t) for t in texts]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.record_batch([b.column("doc_id"), size, pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], names=["doc_id", "n_bytes", "ids", "decoded"])

    return rows.mapInArrow(tidied(encoded, clear), "doc_id long, n_bytes long, ids array<int>, decoded string")


def piece_digest(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_hash, round_trip`` of each text, the ids not put out.

    ``ids_hash`` is the 64-bit xxh3 of the ids as 16-bit little-endian numbers.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_file)
        kind = "<u2" if len(m.surface) <= 65_536 else "<u4"
        for b in sized_batches(batches, most=2 << 20):
            size, count, digest, trip = [], [], [], []
            for t in strings(b.column("text")):
                packed = m.encode_packed(t)
                ids = np.frombuffer(packed, dtype=kind)
                size.append(len(t.encode("utf-8", "surrogatepass")))
                count.append(len(ids))
                digest.append(xxhash.xxh3_64_intdigest(packed) - 2**63)
                trip.append(m.decode(ids.tolist()) == t)
            yield pa.record_batch([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.int64()), pa.array(trip, pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_hash", "round_trip"])

    return rows.mapInArrow(tidied(digested, clear), "doc_id long, n_bytes long, n_pieces long, ids_hash long, round_trip boolean")
