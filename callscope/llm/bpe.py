"""Byte-level BPE encoding and decoding.

A pre-tokeniser pattern cuts each text into pieces; every piece is merged on its own. A segment
tree over the byte positions of a piece keeps, at its root, the leftmost minimum of
(rank of the pair that starts here, position). A merge takes the root, joins the two live
neighbours and makes at most three point updates (the joined pair, the swallowed one, the one to
the left), each climbing log2(length) nodes. Pieces of a batch whose lengths round up to the same
power of two run through their trees together as rows of one array; pieces beyond LOCKSTEP bytes
run alone. Memory is bounded: pieces are processed in blocks and the table of known pieces is
emptied when full and at a task's end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, text_slices

LOCKSTEP = 64
#: Most bytes of pieces and ids that are remembered, about, and what an entry takes besides.
KNOWN_BYTES, ENTRY = 32 << 20, 200
BLOCK_CELLS = 1 << 17
NONE = np.int64(1) << 60
#: No pair, in the 32-bit trees of short pieces.
STEP_NONE = np.int32(2**31 - 1)


class ByteBpe:
    """Ranks of a byte-level vocabulary; ids are the ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
        self.pattern = regex.compile(pattern)
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.asarray(keys, dtype=np.int64))
        self.pair_keys = np.append(np.asarray(keys, dtype=np.int64)[order], NONE)
        self.pair_ranks = np.append(np.asarray(merged, dtype=np.int64)[order], NONE)
        self.pairs = dict(zip(keys, merged, strict=True))
        self.byte_ids = np.asarray([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pair_ranks = np.full((256, 256), STEP_NONE, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pair_ranks[a, b] = self.ranks.get(bytes([a, b]), STEP_NONE)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    # --- many short pieces in step -------------------------------------------------------------

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys.take(at) == keys, self.pair_ranks.take(at), STEP_NONE)

    def encode_in_step(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place < lengths[:, None]
        # one spare cell at each row's end: what follows the last byte
        token = np.zeros((n, width + 1), dtype=np.int64)
        token[:, :width] = self.byte_ids[raw]
        following = np.tile(np.arange(1, width + 2, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width, dtype=np.int32), n)
        tree = np.full((n, 2 * width), STEP_NONE, dtype=np.int32)
        if width > 1:
            rank = self.byte_pair_ranks[raw[:, :-1], raw[:, 1:]]
            fits = (rank < STEP_NONE) & live[:, 1:]
            tree[:, width : 2 * width - 1] = np.where(fits, rank * width + place[:-1], STEP_NONE)
            level = width // 2
            while level:
                np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
                level //= 2
        token, tree, alive = token.reshape(-1), tree.reshape(-1), live.reshape(-1).copy()

        def put(top: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = leaf + width
            tree[top + node] = value
            for _ in range(width.bit_length() - 1):
                child = top + (node & -2)
                node = node >> 1
                tree[top + node] = np.minimum(tree.take(child), tree.take(child + 1))

        rows = np.arange(n)
        while True:
            root = tree.take(rows * (2 * width) + 1)
            some = root < STEP_NONE
            rows, root = rows[some], root[some].astype(np.int64)
            if not len(rows):
                break
            top, cell = rows * (2 * width), rows * (width + 1)
            at = root % width
            merged = root // width
            swallowed = following.take(cell + at).astype(np.int64)
            after = following.take(cell + swallowed).astype(np.int64)
            token[cell + at] = merged
            alive[rows * width + swallowed] = False
            following[cell + at] = after
            before[cell + after] = at
            put(top, swallowed, STEP_NONE)
            rank = self.pair_rank(merged, token.take(cell + after))
            put(top, at, np.where((rank < STEP_NONE) & (after < lengths.take(rows)), rank * width + at, STEP_NONE))
            left = before.take(cell + at).astype(np.int64)
            has = left >= 0
            left, cell, top = left[has], cell[has], top[has]
            rank = self.pair_rank(token.take(cell + left), merged[has])
            put(top, left, np.where(rank < STEP_NONE, rank * width + left, STEP_NONE))
        alive = alive.reshape(n, width)
        ids = token.reshape(n, width + 1)[:, :width][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [ids[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]

    # --- one long piece ------------------------------------------------------------------------

    def encode_alone(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        token = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        pairs, size, none = self.pairs, self.size, int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(token[i] * size + token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            swallowed = following[at]
            after = following[swallowed]
            token[at], following[at], alive[swallowed] = rank, after, 0
            put(swallowed, none)
            new = None
            if after < n:
                before[after] = at
                new = pairs.get(rank * size + token[after])
            put(at, none if new is None else new * width + at)
            left = before[at]
            if left >= 0:
                new = pairs.get(token[left] * size + rank)
                put(left, none if new is None else new * width + left)
        return np.asarray([t for t, a in zip(token, alive, strict=True) if a], dtype="<u4").tobytes()

    # --- texts ---------------------------------------------------------------------------------

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LOCKSTEP:
                self.known[piece] = self.encode_alone(raw)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in by_width.items():
            step = max(1, BLOCK_CELLS // width)
            for i in range(0, len(group), step):
                block = group[i : i + step]
                self.known.update(zip((p for p, _ in block), self.encode_in_step([r for _, r in block], width), strict=True))

    def forget(self) -> None:
        self.known, self.known_bytes = {}, 0

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        cut = [self.pattern.findall(t) for t in texts]
        needed = set().union(*cut)
        missing = needed - self.known.keys()
        if missing:
            # ids take at most four bytes a byte of text
            if self.known_bytes + sum(8 * len(p) + ENTRY for p in missing) > KNOWN_BYTES:
                self.forget()
                missing = needed
            self.known_bytes += sum(8 * len(p) + ENTRY for p in missing)
            self.learn(missing)
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again, one narrow pass without a shuffle.

    Returns id_col, the columns named in keep, n_tokens (long), ids (binary: the ids as little-endian
    unsigned 32-bit integers) and decoded (binary: the bytes of the decoded ids, equal to the text's
    UTF-8). A null text counts as empty: no ids, empty bytes; a very long text is encoded whole.
    Equal ranks merge at the leftmost place. Rows are kept one to one, repeated rows and null ids
    included; an empty table gives no rows. A kept column with the name of a result column is
    refused; other columns of docs are ignored.
    """
    keep = kept_columns(keep, id_col, ("n_tokens", "ids", "decoded"))
    picked = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col), *[F.col(c) for c in keep])
    carried = [f.name for f in picked.schema.fields[1:]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(ranks_path, pattern)
        for batch in batches:
            for part in text_slices(batch, 0, 1 << 20):
                ids = model.encode_texts(part.column(0).to_pylist())
                columns = [part.column(i + 1) for i in range(len(carried))]
                columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "n_tokens", "ids", "decoded"])
        model.forget()

    return picked.mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, decoded binary")
