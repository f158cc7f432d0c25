"""Token ids packed into fixed rows by best-fit decreasing (operator 7).

Texts are encoded with a byte-level BPE vocabulary and an end token. A document over the row width is split into
full rows and a rest, losslessly. Every task packs its documents in groups of about ``GROUP_TOKENS`` tokens: pieces
in falling length, each into the row whose free space fits it best. A segment tree over the free capacities
finds that row in logarithmic time. Nothing is shuffled, and a group's size is bounded, so the packing scales with
the input; a lost task packs the same rows again, as they follow its split of the input.

Of each matrix: ``ids`` (rows x width little-endian, 16 bits if the vocabulary allows, else 32), per row the
cumulative segment lengths (from 0 on) and the position resets (where position ids restart at 0: each segment's
begin), and per segment the document and where in its ids the segment begins. Places after the last segment of
a row hold the end token.

Defined results: a null or empty text has no tokens and is in no row; equal rows are packed as often as they occur;
a null id stays null; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

WIDTH, MATRIX_ROWS, GROUP_TOKENS = 4096, 64, 1 << 21


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """A segment tree over free capacities 1 to ``most``: how many rows have each, and the least that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, free: int) -> None:
        if free:
            self.rows[free].append(row)
            self._add(free, 1)

    def _add(self, free: int, change: int) -> None:
        node = self.size + free
        while node:
            self.tree[node] += change
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free capacity of ``need`` or more, and that capacity; it is taken out."""
        tree, node = self.tree, self.size + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to the first right-hand neighbour in use
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        free = node - self.size
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows of at most ``width`` in all: the numbers of the pieces in each, in the order of placement."""
    free, rows = Capacities(width), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            rows.append([i])
            free.put(len(rows) - 1, width - n)
        else:
            rows[found[0]].append(i)
            free.put(found[0], found[1] - n)
    return rows


def _matrices(ids: list, tokens: list[np.ndarray], width: int, end: int, kind: np.dtype) -> Iterator[dict]:
    piece_doc, piece_at, lengths = [], [], []
    for d, t in enumerate(tokens):
        for at in range(0, len(t), width):
            piece_doc.append(d)
            piece_at.append(at)
            lengths.append(min(width, len(t) - at))
    rows = best_fit_decreasing(np.array(lengths, np.int64), width)
    for first in range(0, len(rows), MATRIX_ROWS):
        some = rows[first : first + MATRIX_ROWS]
        matrix = np.full((len(some), width), end, kind)
        out: dict = {"n_rows": len(some), "width": width, "cu_seqlens": [], "position_resets": [], "doc_ids": [], "token_starts": []}
        for r, pieces in enumerate(some):
            upto = [0]
            for p in pieces:
                matrix[r, upto[-1] : upto[-1] + lengths[p]] = tokens[piece_doc[p]][piece_at[p] : piece_at[p] + lengths[p]]
                upto.append(upto[-1] + lengths[p])
            out["cu_seqlens"].append(upto)
            out["position_resets"].append(upto[:-1])
            out["doc_ids"].append([ids[piece_doc[p]] for p in pieces])
            out["token_starts"].append([piece_at[p] for p in pieces])
        yield out | {"n_tokens": sum(u[-1] for u in out["cu_seqlens"]), "ids": matrix.tobytes()}


def pack(docs: DataFrame, vocabulary: str, pattern: str, end_token: int, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per matrix: matrix (a name), n_rows, width, n_tokens, ids, cu_seqlens, position_resets, doc_ids, token_starts."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    fields = f"matrix string, n_rows int, width int, n_tokens long, ids binary, cu_seqlens array<array<int>>, position_resets array<array<int>>, doc_ids array<array<{kind}>>, token_starts array<array<int>>"
    size = np.dtype("<u2" if end_token < 1 << 16 else "<u4")

    def run(batches):
        encode = encoder(vocabulary, pattern)
        partition, number = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[np.ndarray] = []
        held, id_type = 0, pa.int64()

        def flush():
            nonlocal number, held
            lists = pa.list_(pa.list_(pa.int32()))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), lists, lists, pa.list_(pa.list_(id_type)), lists]
            schema = pa.schema(list(zip(names, types, strict=True)))
            for m in _matrices(ids, tokens, width, end_token, size):
                yield pa.RecordBatch.from_pylist([m | {"matrix": f"{partition:06d}-{number:06d}"}], schema)
                number += 1
            ids.clear()
            tokens.clear()
            held = 0

        names = ["matrix", "n_rows", "width", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "token_starts"]
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                encoded = encode.encode_to_numpy(text, disallowed_special=())
                one = np.append(encoded.astype(size), size.type(end_token))
                ids.append(key)
                tokens.append(one)
                held += len(one)
                if held >= GROUP_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    return source.mapInArrow(run, fields)


def position_ids(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position ids of one row: each segment counts from 0, as do the places after the last one."""
    begins = np.zeros(width, np.int64)
    cuts = [c for c in cu_seqlens if c < width]
    begins[cuts] = cuts
    return np.arange(width) - np.maximum.accumulate(begins)


def write(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet, ids as raw binary."""
    packed.write.mode("overwrite").parquet(path)
