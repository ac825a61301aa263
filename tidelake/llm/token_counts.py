"""Token counts: whole texts through a public tokenizer, lengths only.

An Arrow function encodes batches of about equal bytes.  A long text is cut
where no token can reach across: before a single blank between two visible
characters, which the tokenizer's own rule for words always starts a new word
at.  So the sum over the pieces is the count of the whole text.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
give repeated results; special strings inside texts count as the library's
default has them; columns of any name pass through.

A byte-level BPE file of the usual kind is run by the faster of two libraries that
give the same tokens (tests hold one against the other); any other file by its own.
SentencePiece texts stay whole, as its rule promises no safe place.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelake.llm.runtime import free_name

TOKENS = T.StructType([T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])
_ARROW = pa.struct([pa.field("n_bytes", pa.int64(), False), pa.field("n_tokens", pa.int64(), False)])

# Fixed value: the public split rule of byte-level BPE with ``use_regex``.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _as_ranks(path: str):
    """The encoder of a byte-level BPE file in the faster library, or None if the
    file asks for anything by which the two libraries could differ."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec.get("added_tokens", [])):
        return None
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):  # merges must rank as the ids of their results
        return None
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if token not in added}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from a list of texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    fast = _as_ranks(path)
    if fast is not None:
        return lambda texts: [len(fast.encode(x, allowed_special="all")) for x in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str, most: int) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut at safe places only."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def _count(texts: list[str | None], path: str, batch_bytes: int, piece_chars: int) -> list[int]:
    counter = _counter(path)
    totals = [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, counter(parts)):
            totals[owner] += n
        parts.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for part in pieces(text or "", piece_chars if path.endswith(".json") else len(text or "")):
            if part:
                parts.append(part)
                owners.append(k)
                held += len(part.encode("utf-8", "surrogatepass"))
                if held >= batch_bytes:
                    flush()
                    held = 0
    flush()
    return totals


def count_tokens(docs: DataFrame, path: str, text: str = "text", batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """``docs`` with a struct column ``tokens`` (underscores in front if the name is taken)."""
    name = free_name(docs, "tokens")
    at = docs.columns.index(text)
    # The file goes to all machines with the job.
    docs.sparkSession.sparkContext.addFile(path)
    file = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        for batch in batches:
            column = batch.column(at)
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = _count(column.to_pylist(), SparkFiles.get(file), batch_bytes, piece_chars)
            both = pa.StructArray.from_arrays([pa.array(sizes), pa.array(counts, pa.int64())], fields=list(_ARROW))
            yield pa.RecordBatch.from_arrays([*batch.columns, both], names=[*batch.schema.names, name])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(name, TOKENS, False)]))
