"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree for certain."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.pretokens import WHITE, classes_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"
#: Code points between a splice and the edges of its overlap.
MARGIN = 8


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens (bytes) and special tokens with their ids, of a byte-level tokenizer.json."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}, special


@functools.cache
def encoder(path: str):
    """(encode: text to ids, size: bytes of each id, merge: one piece to ids) for a byte-level vocabulary whose merges go by
    id.

    The ids are those of the tokenizers library, which reads the same file at a quarter of the speed; the tests hold
    both against each other.
    """
    import public_tokenizers
    import tiktoken

    tokens, special = vocabulary(path)
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens=special)
    size = np.zeros(max([*tokens.values(), *special.values()]) + 1, np.int64)
    for token, i in tokens.items():
        size[i] = len(token)
    for token, i in special.items():
        size[i] = len(token.encode())
    return lambda text: engine.encode(text, allowed_special="all"), size, engine._encode_single_piece


def _aligned(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _stable(data: bytes, begin: int, stop: int, ends: np.ndarray, fresh: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Places in data[begin:stop], which one encoding (token ends `ends`) ends with and another (`fresh`) starts with, where
    the first may hand over to the second.

    Both must end a token there, away from the edges of the overlap, and not within a special string. Then it is enough that
    a piece ends there whatever lies before or behind: white space after any other sign, or two of letters, numbers and
    other signs side by side (but for the apostrophe of contractions). Or the place lies in one run of letters, numbers,
    signs or white space, and both have one and the same token before it: a sequence of tokens whose neighbours all merge
    to themselves is what the merges give for their piece, and each pair of neighbours here is found in one of the two.
    """
    raw = np.frombuffer(data, np.uint8, stop - begin, begin)
    heads = np.flatnonzero((raw & 0xC0) != 0x80) + begin
    kinds = classes_of(codes := np.frombuffer(data[begin:stop].decode().encode("utf-32-le"), np.uint32))
    at, old, new = np.intersect1d(ends, fresh, assume_unique=True, return_indices=True)
    one_token = np.where(old > 0, ends[old - 1], -1) == np.where(new > 0, fresh[new - 1], begin)
    k = np.searchsorted(heads, at)
    inside = (k >= MARGIN) & (k + MARGIN <= len(heads))
    inside[inside] &= heads[k[inside]] == at[inside]
    for string in special:
        found = data.find(string, max(0, begin - len(string)))
        while 0 <= found < stop:
            inside &= (at <= found) | (at >= found + len(string))
            found = data.find(string, found + 1)
    at, k, one_token = at[inside], k[inside], one_token[inside]
    before, after = kinds[k - 1], kinds[k]
    piece = (before != WHITE) & (before != after) & ((codes[k - 1] != ord("'")) | (after == WHITE))
    changes = np.append(0, np.cumsum(kinds[1:] != kinds[:-1]))
    run = changes[k - 4] == changes[k + 3]
    return at[piece | (run & one_token)]


def count_spliced(data: bytes, encode, size: np.ndarray, chunk: int, overlap: int, special: list[bytes] = ()) -> tuple[int, int]:
    """(tokens, chunks) of one UTF-8 text of any length."""
    total, chunks, begin, stop = 0, 1, 0, _aligned(data, min(chunk, len(data)))
    ends = np.cumsum(size[encode(data[:stop].decode())])
    skipped = 0  # tokens of the current chunk that lie before its splice
    while stop < len(data):
        reach = overlap
        while True:
            # the next chunk begins where a token of this one does, so that runs of one sign are in step
            starts = ends[: np.searchsorted(ends, stop - reach, "right")][::-1]
            again = next((e for e in starts[:64].tolist() if _aligned(data, e) == e), begin)
            if again > begin:
                further = _aligned(data, min(len(data), again + max(chunk, 2 * (stop - again))))
                fresh = again + np.cumsum(size[encode(data[again:further].decode())])
                chunks += 1
                common = _stable(data, again, stop, ends, fresh, special)
                if len(common):
                    splice = int(common[-1])
                    total += int(np.searchsorted(ends, splice, "right")) - skipped
                    begin, stop, ends, skipped = again, further, fresh, int(np.searchsorted(fresh, splice, "right"))
                    break
            else:  # nothing in all of the chunk: it grows
                stop = _aligned(data, min(len(data), begin + 2 * (stop - begin)))
                ends = begin + np.cumsum(size[encode(data[begin:stop].decode())])
                chunks += 1
                if stop == len(data):
                    break
            reach *= 2
        if stop == len(data):
            break
    return total + len(ends) - skipped, chunks


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 9) -> DataFrame:
    """n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks of every whole text.

    A text over `chunk` bytes (at most 2^18, which the engine's recursion allows) is encoded in chunks that overlap by
    `overlap` bytes. A boundary that both encodings have in the overlap, and that is proven to hold for the whole text (see
    _stable), is where one takes over from the other; where there is none, the overlap doubles, and at last the chunk
    itself. A null text is empty (0 tokens); special strings inside texts count as the special token, as by the library's
    default; repeated rows and null ids are rows like others; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size, _ = encoder(tokenizer)
        special = [token.encode() for token in vocabulary(tokenizer)[1]]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                if len(text) <= chunk // 4 or len(data := text.encode()) <= chunk:
                    rows.append((len(text.encode()), len(encode(text)), 1))
                else:
                    rows.append((len(data), *count_spliced(data, encode, size, chunk, overlap, special)))
            n_bytes, n_tokens, n_chunks = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(n_chunks.astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
