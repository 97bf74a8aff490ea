"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file becomes a ``tokenizers`` BPE model whose symbols are the usual
byte-to-character images.  Every way to split a token into two known tokens is a
merge rule, ordered by the token's rank, so the model joins exactly the pairs
that rank-based merging joins.

A match of the public split pattern never holds a non-space character followed by
white space, so with it a text can be cut in front of each white-space run and the
parts encoded one by one.  Parts repeat a lot: each is encoded once per batch, and a
bounded table keeps the codes of parts for the batches that follow.  With any other
pattern a text is matched whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of the part table of one worker; it is emptied when it gets larger.
PART_TABLE = 150_000

# Unicode White_Space, which the split pattern's \s stands for.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_symbols() -> list[str]:
    """Printable character for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder for one rank file (``base64-token rank`` per line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        from tokenizers.models import BPE

        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in lines}
        symbols = byte_symbols()

        def image(token: bytes) -> str:
            return "".join([symbols[b] for b in token])

        merges = [(image(tok[:i]), image(tok[i:]))
                  for tok in sorted(ranks, key=ranks.__getitem__)
                  for i in range(1, len(tok)) if tok[:i] in ranks and tok[i:] in ranks]
        self.model = BPE(vocab={image(t): r for t, r in ranks.items()}, merges=merges,
                         ignore_merges=True, cache_capacity=0)
        self.images = dict(enumerate(symbols))  # for str.translate on latin-1 text
        self.matches = regex.compile(pattern).findall
        self.cuttable = pattern == public_tokenizers.PATTERN
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in ranks.values()}
        self.codes: dict[str, tuple[int, ...]] = {}

    def _encode_part(self, part: str) -> tuple[int, ...]:
        tokenize, images = self.model.tokenize, self.images
        return tuple([t.id for piece in self.matches(part) for t in
                      tokenize(piece.encode("utf-8").decode("latin-1").translate(images))])

    def encode(self, text: str) -> list[int]:
        if not self.cuttable:
            return list(self._encode_part(text))
        parts = _PARTS.findall(text)
        codes = self.codes
        if len(codes) > PART_TABLE:
            codes.clear()
        for part in set(parts).difference(codes):
            codes[part] = self._encode_part(part)
        return list(chain.from_iterable(map(codes.__getitem__, parts)))

    def decode_bytes(self, ids) -> bytes:
        """Bytes of the ids; unknown ids raise KeyError."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of the ids; a character split by the cut of the ids gives U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids) -> np.ndarray:
        """(start, end) in code points per token.

        Both ends of a token that holds only part of a character cover that
        whole character.
        """
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # character index of each byte
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if not len(ends):
            return np.zeros((0, 2), np.int64)
        return np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank file; built once per worker and file."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _rank_bytes(df: DataFrame, path: str):
    """The rank file (fixed size, under 1 MB) as a broadcast value."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>[, starts, ends array<long>])``, one row per input row.

    Null and empty texts give empty arrays.  Any other column is left out, so
    names cannot clash.  Rows are independent: repeated rows repeat.
    """
    ranks = _rank_bytes(docs, path)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id long, ids array<int>"
    if with_offsets:
        schema += ", starts array<long>, ends array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [c.encode(t) for t in texts]
            cols = [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            names = ["doc_id", "ids"]
            if with_offsets:
                spans = [c.offsets(t, i) for t, i in zip(texts, ids)]
                cols += [pa.array([s[:, k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary`` (the exact bytes) and ``decoded_text`` (UTF-8,
    U+FFFD for characters that the ids cut) to ``(doc_id, ids)`` rows."""
    ranks = _rank_bytes(encoded, path)
    src = encoded.select("doc_id", encoded[ids_col].alias("ids"))

    def run(batches):
        c = codec(ranks.value, pattern)
        for batch in batches:
            raw = [c.decode_bytes(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary()),
                 pa.array([r.decode("utf-8", errors="replace") for r in raw], pa.string())],
                ["doc_id", "ids", "decoded", "decoded_text"])

    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded binary, decoded_text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids and returns digests of both.

    ``doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string``; a null
    text counts as empty.  One pass: ids never leave the task that makes them.
    """
    ranks = _rank_bytes(docs, path)
    src = docs.select("doc_id", "text")

    def run(batches):
        c = codec(ranks.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                coded.append(sha(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(c.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_tokens long``, ``ids array<int>`` and
    ``decoded_sha256 string`` (of the bytes that the ids decode to), one row per input
    row; null and empty texts have no ids."""
    ranks = _rank_bytes(docs, path)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *keep, docs["text"].alias("text"))

    def run(batches):
        c = codec(ranks.value, pattern)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            sha = [hashlib.sha256(c.decode_bytes(i)).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array([len(i) for i in ids], pa.int64()),
                                      pa.array(ids, pa.list_(pa.int32())), pa.array(sha, pa.string())],
                ["doc_id", *keep, "n_tokens", "ids", "decoded_sha256"])

    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return src.mapInArrow(run, f"doc_id long, {kept}n_tokens long, ids array<int>, decoded_sha256 string")
