"""Token ids for the packing operators: one tokenizer, read on the driver, sent to the tasks, used a chunk at a time.

The rank file holds the vocabulary of the JSON file; ids of both are equal (a test compares them), but the rank
library needs a quarter of the CPU time of the other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Tokens that a task packs together: its memory bound, and the pool that packing chooses from.
BLOCK_TOKENS = 6_000_000


class Pieces:
    """Ids of text chunks, each text followed by the end id."""

    def __init__(self, ranks: bytes, pattern: str, end_id: int):
        self.ranks, self.pattern, self.end_id, self.encoder = ranks, pattern, end_id, None

    def __call__(self, text: str | None) -> np.ndarray:
        if self.encoder is None:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.encoder = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        ids = self.encoder.encode_to_numpy(text, disallowed_special=()) if text else ()
        out = np.empty(len(ids) + 1, dtype="<u4")
        out[:-1], out[-1] = ids, self.end_id
        return out


def tokenizer(path: str | None = None, pattern: str | None = None, end_id: int = 1) -> Pieces:
    """Read the rank file ``path`` (default: the public 50k byte-level vocabulary) on the driver."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return Pieces(f.read(), pattern or public_tokenizers.PATTERN, end_id)


def token_blocks(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids of documents, token arrays) of about BLOCK_TOKENS tokens; a longer text is a block's last document."""
    names, arrays, size = [], [], 0
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for i, doc in enumerate(docs):
            names.append(doc)
            arrays.append(pieces(batch.column("text")[i].as_py()))
            size += len(arrays[-1])
            if size >= BLOCK_TOKENS:
                yield names, arrays
                names, arrays, size = [], [], 0
    if names:
        yield names, arrays
