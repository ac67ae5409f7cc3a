"""Sizes of documents in tokens of a public tokenizer, with what packing and mixing need besides.

The tokenizer file (ranks of a byte-level vocabulary) is a parameter; it is loaded once per task from the path given,
which must exist on every executor.
"""

from __future__ import annotations

import base64
import importlib.util
import math
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import spread

DIMS, BITS, HASHED = 3, 10, 256
# Fixed value: how the public byte-level vocabularies cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public tokenizer files are on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name) if spec and spec.origin else f"/opt/tokenizers/{name}"


def projection(seed: int = 11) -> np.ndarray:
    """Fixed random directions from the hashed space to few dimensions."""
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def hilbert_key(point: Sequence[int], bits: int = BITS) -> int:
    """Index of a grid point along the Hilbert curve (Skilling's transposed form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | v >> b & 1
    return key


def document_key(ids: np.ndarray, directions: np.ndarray) -> int:
    """Hilbert key of a document: hashed token counts, projected, each coordinate by its normal quantile."""
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    counts = np.bincount((h & np.uint64(HASHED - 1)).astype(np.int64), np.where(h & np.uint64(1 << 20), 1.0, -1.0), HASHED)
    length = float(np.linalg.norm(counts)) or 1.0
    grid = [min((1 << BITS) - 1, int((0.5 + 0.5 * math.erf(float(c) / math.sqrt(2))) * (1 << BITS))) for c in counts @ directions / length]
    return hilbert_key(grid)


def cut(ends: np.ndarray, whole: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Token ranges of at most ``capacity`` tokens, cut only where a character ends (``whole``); a character of more tokens stays whole."""
    parts, a, n = [], 0, len(ends)
    while a < n:
        b = min(n, a + capacity)
        c = b
        while c > a and not whole[c - 1]:
            c -= 1
        if c == a:
            c = b
            while not whole[c - 1]:
                c += 1
        parts.append((a, c))
        a = c
    return parts


def char_parts(text: str, ids: np.ndarray, sizes: np.ndarray, limits: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """For each limit that the tokens exceed: (limit, part, first character, end character, tokens)."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)  # bytes at which a character starts, and the end
    char_at = np.cumsum(starts) - 1
    ends = np.cumsum(sizes[ids])
    whole = starts[ends]
    out = []
    for limit in limits:
        if len(ids) > limit:
            for k, (a, b) in enumerate(cut(ends, whole, limit), 1):
                out.append((limit, k, int(char_at[ends[a - 1]]) if a else 0, int(char_at[ends[b - 1]]), b - a))
    return out


def load_ranks(path: str, pattern: str):  # noqa: ANN201
    """The tokenizer of a rank file, and the bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_sizes(docs: DataFrame, tokenizer: str, capacities: Sequence[int] = (), pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_chars``, ``curve`` (Hilbert key), ``quality`` in (0, 1] and ``parts`` for each capacity the text exceeds.

    Whole texts are tokenized. Null texts and null ids give no row, an empty text has 0 tokens.
    """
    limits = sorted({int(c) for c in capacities})
    schema = "doc_id bigint, n_tokens int, n_chars int, curve bigint, quality double, parts array<struct<capacity:int,part_no:int,start_pos:int,end_pos:int,n_tokens:int>>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sizes = load_ranks(tokenizer, pattern)
        directions = projection()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.asarray(coder.encode_ordinary(text), dtype=np.int64)
                n = len(ids)
                parts = char_parts(text, ids, sizes, limits) if limits and n > limits[0] else []
                variety = len(np.unique(ids)) / n if n else 0.0
                quality = max(0.05, 0.5 * min(1.0, n / 128) + 0.5 * min(1.0, variety * max(1.0, math.log10(n + 1) / 1.5)))
                rows.append((key, n, len(text), document_key(ids, directions), quality, parts))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_chars", "curve", "quality", "parts"])

    return spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id").mapInPandas(measure, schema)
