"""Byte-level BPE with the tiktoken library over a local rank file.

Long texts are cut before they are encoded, only where the splitting pattern has a boundary whatever surrounds it, so
the ids are those of the whole text. A single match longer than ``LONG_PIECE`` bytes is merged here with a heap, as the
library's own merge takes time that grows with the square of a match's length.

Edge cases: a null text is the empty text, which has no ids; ids decode to the raw bytes of the text; repeated rows are
encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

CHUNK = 64_000  # characters given to the library at once, about
LONG_PIECE = 4_000  # bytes of one match


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _kind(c: str) -> int:
    """0 white space, 1 letter, 2 number, 3 other: the classes of the pattern."""
    return 0 if c.isspace() or "\x1c" <= c <= "\x1f" else 1 if c.isalpha() else 2 if c.isnumeric() else 3


def safe_boundaries(text: str, chunk: int = CHUNK):
    """Cuts ``text`` in parts of about ``chunk`` characters, each cut before white space that follows something else:
    no match of the pattern spans such a place, and none looks back. Where there is none, the part stays longer."""
    at, n = 0, len(text)
    while n - at > chunk:
        end = at + chunk
        while end < n and not (text[end] in " \n\t\r" and text[end - 1] not in " \n\t\r" and _kind(text[end - 1])):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one match: the lowest rank merges first, the leftmost first among equals; n log n."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt, prev, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != e or ranks.get(piece[i:e]) != r:
            continue
        alive[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (q := ranks.get(piece[i : end[nxt[j]]])) is not None:
                heapq.heappush(heap, (q, i, end[nxt[j]]))
        if prev[i] >= 0 and (q := ranks.get(piece[prev[i] : e])) is not None:
            heapq.heappush(heap, (q, prev[i], e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder for one table of ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, long_piece: int = LONG_PIECE):
        import regex
        import tiktoken

        self.ranks, self.chunk, self.long_piece = ranks, chunk, long_piece
        self.pattern = regex.compile(pattern)
        self.lib = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.space_run = regex.compile(rf"\s{{{long_piece // 4}}}")
        self.bytes = {r: b for b, r in self.ranks.items()}

    def _has_long(self, part: str) -> bool:
        """Whether a match may be longer than long_piece bytes: a character has four bytes at most."""
        return len(part) >= self.long_piece // 4 and (max(map(len, part.split()), default=0) >= self.long_piece // 4 or bool(self.space_run.search(part)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in safe_boundaries(text, self.chunk) if len(text) > self.chunk else (text,):
            if self._has_long(part):
                for piece in self.pattern.findall(part):
                    raw = piece.encode()
                    out += merge_piece(raw, self.ranks) if len(raw) > self.long_piece else self.lib._encode_single_piece(raw)
            else:
                out += self.lib.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: a cut through a character stays a cut."""
        return self.lib.decode_bytes(ids)


@functools.cache
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(read_ranks(rank_file), pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * ids

    def run(batches):
        code = codec(rank_file, pattern)
        names = [str(i) for i in range(max(code.bytes) + 1)]
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 if ids else 4)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = code.encode(text.as_py() or "")
                raw = code.decode(found)
                row = (doc, len(found), hashlib.sha256(",".join([names[i] for i in found]).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), found, raw)
                for col, x in zip(cols, row):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_files

    return encode_documents(documents(spark, sf_dir), tokenizers_files.path("byte_bpe_multi_50k.tiktoken"), tokenizers_files.PATTERN, ids=False)
