"""Sizes of documents in tokens of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this family of tokenizers cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file; one a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_tokens(tokens: list[int], capacity: int, path: str = TOKENIZER) -> list[tuple[int, int, int, int]]:
    """Pieces of at most capacity tokens as (from_token, to_token, from_char, to_char).

    A piece ends before a token that begins a character, so that every piece is valid text; a
    run of tokens without such a place is cut at the capacity.
    """
    enc = encoder(path)
    out, at, char = [], 0, 0
    while at < len(tokens):
        end = min(at + capacity, len(tokens))
        while at < end < len(tokens) and 0x80 <= enc.decode_single_token_bytes(tokens[end])[0] < 0xC0:
            end -= 1
        if end == at:
            end = min(at + capacity, len(tokens))
        n = len(enc.decode_bytes(tokens[at:end]).decode("utf-8", "ignore"))
        out.append((at, end, char, char + n))
        at, char = end, char + n
    return out


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sizes, pa.int32())], [*(batch.schema.names[i] for i in rest), "tokens"])

    return run


def token_counts(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns keep and ``tokens``, without the text; null and empty texts have 0 tokens."""
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "tokens int"])
    return documents.select(*keep, "text").mapInArrow(_counts(path), schema)
