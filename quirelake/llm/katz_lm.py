"""What the language model is made from: which documents train, tokens of chunks of documents, and Good-Turing discounts.

Words are lower-cased (A-Z) and hashed to 64 bits; the end of a text is token 0. Nulls and edge cases: a null or blank
text is the end token alone; a null doc_id is trained on like the others (its remainder is not 2). Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from quirelake.llm.common import byte_words

FOLDS, HELD = 7, 2
#: Counts up to K are discounted.
K = 5
#: Tokens of a chunk, about.
CHUNK_TOKENS = 1_500_000

END = np.uint64(0)
_WORD = xxhash.xxh64_intdigest


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def chunks(batches: Iterator[pa.RecordBatch], tokens: int = CHUNK_TOKENS) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray]]:
    """doc_ids, text hashes, word hashes of all tokens with the ends, and each token's document number (uint16)."""
    ids, marks, parts, lengths, total = [], [], [], [], 0
    for batch in batches:
        for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = cell.as_py()
            words = byte_words(text)
            h = np.fromiter(map(_WORD, words), np.uint64, len(words))
            h[h == END] = 1
            ids.append(doc_id)
            marks.append(_WORD((text or "").encode("utf-8", "surrogatepass")) - 2**63)
            parts += [h, np.zeros(1, np.uint64)]
            lengths.append(len(h) + 1)
            total += len(h) + 1
            if total >= tokens or len(ids) == 2**16:
                yield ids, marks, np.concatenate(parts), np.repeat(np.arange(len(ids)), lengths)
                ids, marks, parts, lengths, total = [], [], [], [], 0
    if ids:
        yield ids, marks, np.concatenate(parts), np.repeat(np.arange(len(ids)), lengths)


def discounts(n: dict[int, int]) -> np.ndarray:
    """Good-Turing discount factors of counts 1 to K from the counts of counts 1 to K + 1; half-count discounts where these are no use."""
    plain = np.array([(r - 0.5) / r for r in range(1, K + 1)])
    if any(n.get(r, 0) == 0 for r in range(1, K + 2)):
        return plain
    top = (K + 1) * n[K + 1] / n[1]
    d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if top != 1 else 1.0 for r in range(1, K + 1)])
    return d if np.all((d > 0) & (d < 1)) else plain
