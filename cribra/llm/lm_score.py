"""Documents scored by the cross-entropy difference of two n-gram language models.

Tokens are words, so target and background models share one vocabulary; they also
share order and smoothing, and the background's counts are scaled to the target's
total, so that neither is favoured for its size.  A document's score is the mean over
its tokens of the target's loss minus the background's: the lower, the more the
document is like the target.

All documents are counted.  Texts are dealt into chunks of about CHUNK_CHARS by a hash
of doc_id.  A chunk counts its own n-grams first, as sorted arrays cut into buckets by
key ranges.  In a bucket the chunks' arrays meet once, whatever the n-gram at most one
entry of each chunk, and every chunk gets the sums back in the order of its own keys.
No model is ever held whole, so it may grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import persist_shared
from cribra.llm.substrings import word_hashes

#: Words of an n-gram, and code points of a chunk.
ORDER, CHUNK_CHARS = 2, 8_000_000
#: Code points of the corpus for each bucket: bounds what a bucket's task holds.
BUCKET_CHARS = 12_000_000
#: Tokens' worth of belief in the next lower order.
PRIOR = 4.0
#: Bytes of text that are cut into words at a time.
SLICE = 1 << 20

_U = np.uint64
#: The word that stands before a text, and per order a number of its own.
_START, _STEP = _U(0x5851F42D4C957F2D), _U(0x9E3779B97F4A7C15)


def _slices(texts: list[bytes]):
    """Ranges of texts with about SLICE bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


class _Chunk:
    """Word n-grams of the texts of a chunk.

    Each text stands behind ``order`` start words.  Of a text of n words, place 0 is the
    start and places 1 to n its words; empty texts have no places.  The k-gram that ends
    at a place is counted as a gram (places 1 to n) and as the context of the next word
    (places 0 to n - 1).
    """

    def __init__(self, texts: list[bytes], order: int):
        found, sizes = [], []
        for start, end in _slices(texts):
            hashes, firsts = word_hashes(texts[start:end])
            found.append(hashes)
            sizes.append(np.diff(firsts))
        words = np.concatenate(found) if found else np.zeros(0, _U)
        self.sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        full = np.flatnonzero(self.sizes)
        n = self.sizes[full]
        ends = np.cumsum(n + order)
        line = np.full(int(ends[-1]) if len(n) else 0, _START, _U)
        shift = np.repeat((np.arange(len(full)) + 1) * order, n)
        line[np.arange(len(words)) + shift] = words
        small = np.int32 if len(line) < 1 << 31 else np.int64
        self.text = np.repeat(full.astype(small), n + 1)  # text of each place
        first = ends - n - 1  # place 0 of each text
        self.at = np.arange(len(self.text), dtype=small)
        self.at += np.repeat((first - (np.cumsum(n + 1) - n - 1)).astype(small), n + 1)
        self.gram = np.ones(len(self.text), bool)
        self.context = np.ones(len(self.text), bool)
        stops = np.cumsum(n + 1)
        self.gram[stops - n - 1] = False
        self.context[stops - 1] = False
        self.line = line

    def keys(self, k: int) -> np.ndarray:
        """The k-gram that ends at each place, as a 64-bit hash."""
        h = np.full(len(self.at), _U(k) * _STEP, _U)
        for j in reversed(range(k)):
            h = (h ^ self.line[self.at - j]) * _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(29)
        return h * _U(0x94D049BB133111EB)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets' ranges in sorted keys."""
    number = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
    return np.searchsorted(number, np.arange(buckets, dtype=_U), side="right")


def _packed(x: np.ndarray) -> bytes:
    """Counts, most of them small: their number, a byte each (255: at least that), and the
    places and values of the large ones."""
    large = np.flatnonzero(x >= 255)
    return (np.array([len(x)], np.uint64).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()
            + large.astype(np.uint32).tobytes() + x[large].astype(np.uint64).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.uint64, 1)[0])
    out = np.frombuffer(b, np.uint8, n, 8).astype(np.int64)
    large = (len(b) - 8 - n) // 12
    places = np.frombuffer(b, np.uint32, large, 8 + n)
    out[places] = np.frombuffer(b[8 + n + 4 * large:], np.uint64).astype(np.int64)
    return out


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps of as many bytes as the largest needs, which the first byte says."""
    gaps = np.diff(keys, prepend=_U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(b: bytes) -> np.ndarray:
    gaps = np.zeros(((len(b) - 1) // b[0], 8), np.uint8)
    gaps[:, :b[0]] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    return np.cumsum(gaps.view("<u8").ravel(), dtype=_U)


def _encoded(column) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


#: Counts of an entry: as a gram and as a context, in target and in all documents.
_COUNTS = ("t", "b", "tc", "bc")
_BUCKET = ("distinct", "total_t", "total_b")


def _count(docs: DataFrame, ids: DataFrame, order: int, buckets: int) -> DataFrame:
    """``bucket, chunk, k, keys, t, b, tc, bc``: a chunk's n-grams of order k."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(_encoded(left["text"]), order)
        target = np.isin(left["doc_id"].fill_null(0).to_numpy(), right["doc_id"].to_numpy())
        target &= left["doc_id"].is_valid().to_numpy()
        hit = target[chunk.text]
        rows = {c: [] for c in ("bucket", "chunk", "k", "keys", *_COUNTS)}
        number = left["chunk"][0].as_py() if left.num_rows else 0
        for k in range(1, order + 1):
            own, inv = np.unique(chunk.keys(k), return_inverse=True)
            # the longest n-grams are no contexts
            some = (chunk.gram & hit, chunk.gram, chunk.context & hit, chunk.context)[:4 if k < order else 2]
            counts = [np.bincount(inv[m], minlength=len(own)) for m in some]
            start = 0
            for bucket, end in enumerate(_cuts(own, buckets)):
                if end > start:
                    for c, x in zip(rows, (bucket, number, k, _packed_keys(own[start:end]),
                                           *[_packed(x[start:end]) for x in counts], None, None)):
                        rows[c].append(x)
                start = end
        kinds = [pa.int32(), pa.int64(), pa.int32()] + 5 * [pa.binary()]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(rows.items(), kinds)})

    return docs.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(
        run, "bucket int, chunk long, k int, keys binary, t binary, b binary, tc binary, bc binary")


def _answer(counts: DataFrame) -> DataFrame:
    """``chunk, k, bucket, distinct, total_t, total_b, t, b, tc, bc``: the sums over all
    chunks of each chunk's keys, in their order; ``distinct`` and the totals are the
    number of grams in the bucket and their counts."""
    def run(table: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(b) for b in table["keys"].to_pylist()]
        own, inv = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        out: dict = {"chunk": table["chunk"], "k": table["k"], "bucket": table["bucket"]}
        sums = {}
        for c in _COUNTS:
            if table[c].null_count:
                out[c] = pa.nulls(table.num_rows, pa.binary())
                continue
            flat = np.concatenate([_unpacked(b) for b in table[c].to_pylist()])
            sums[c] = np.zeros(len(own), np.int64)
            np.add.at(sums[c], inv, flat)
            back = sums[c][inv]
            out[c] = pa.array([_packed(back[e - len(k):e]) for k, e in zip(keys, ends)], pa.binary())
        for c, n in zip(_BUCKET, ((sums["b"] > 0).sum(), sums["t"].sum(), sums["b"].sum())):
            out[c] = pa.array([int(n)] * table.num_rows, pa.int64())
        return pa.table({c: out[c] for c in ("chunk", "k", "bucket", *_BUCKET, *_COUNTS)})

    return counts.groupBy("k", "bucket").applyInArrow(
        run, "chunk long, k int, bucket int, distinct long, total_t long, total_b long, "
             "t binary, b binary, tc binary, bc binary")


def score(docs: DataFrame, target_ids: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row of
    ``docs(doc_id, text)``; the target is the documents whose id is in
    ``target_ids(doc_id)``, the background all documents.

    Tokens are words cut at ASCII white space.  Order k believes its own counts as far
    as they go and ``prior`` tokens' worth of order k - 1; order 0 is uniform over the
    words of all documents.  N-grams are told apart by 64-bit hashes.  Losses are means
    per token in nats.  Null and empty texts have 0 tokens and null losses and score.
    Without any target text the target knows nothing but the vocabulary.  Repeated rows
    are counted and scored each; ids may repeat in ``target_ids``; other columns are
    ignored; an empty table gives no rows.
    """
    if order < 1:
        raise ValueError(f"order {order} is not positive")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-chars // CHUNK_CHARS))
    buckets = max(1, -(-chars // BUCKET_CHARS))
    chunk = lambda key: F.pmod(F.hash(key), F.lit(chunks)).cast("long").alias("chunk")
    # rows without doc_id go by their text
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"),
                    chunk(F.coalesce("doc_id", F.xxhash64("text"))))
    ids = target_ids.filter("doc_id IS NOT NULL").select("doc_id").distinct() \
                    .select("doc_id", chunk(F.col("doc_id")))
    answers = persist_shared(_answer(_count(d, ids, order, buckets)), "answers", compression="zstd")
    ones = answers.filter("k = 1").groupBy("bucket").agg(*[F.max(c).alias(c) for c in _BUCKET])
    vocabulary, in_target, words = (n or 0 for n in ones.agg(*[F.sum(c) for c in _BUCKET]).first())
    scale = in_target / words if words else 0.0

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _Chunk(_encoded(left["text"]), order)
        gram, before = np.flatnonzero(texts.gram), np.flatnonzero(texts.context)
        sums = {}
        table = right.sort_by([("k", "ascending"), ("bucket", "ascending")]) if right.num_rows else right
        for k in range(1, order + 1):
            rows = table.filter(pa.array(table["k"].to_numpy() == k)) if table.num_rows else table
            sums[k] = {c: np.concatenate([_unpacked(b) for b in rows[c].to_pylist()] or [np.zeros(0, np.int64)])
                       for c in _COUNTS[:4 if k < order else 2]}
        losses = []
        for count, context, by, total in (("t", "tc", 1.0, in_target), ("b", "bc", scale, words * scale)):
            q = np.full(len(gram), 1.0 / max(1, vocabulary))
            seen = np.full(len(gram), float(total))
            for k in range(1, order + 1):
                inv = np.unique(texts.keys(k), return_inverse=True)[1]
                q = (sums[k][count][inv[gram]] * by + prior * q) / (seen + prior)
                if k < order:  # the places before the words are the contexts of the next order
                    seen = sums[k][context][inv[before]] * by
            losses.append(np.bincount(texts.text[gram], -np.log(q), len(texts.sizes)))
        none = texts.sizes == 0
        mean = [x / np.maximum(1, texts.sizes) for x in losses]
        return pa.table({
            "doc_id": left["doc_id"], "n_tokens": pa.array(texts.sizes),
            "target_loss": pa.array(mean[0], mask=none), "background_loss": pa.array(mean[1], mask=none),
            "score": pa.array(mean[0] - mean[1], mask=none)})

    return d.groupBy("chunk").cogroup(answers.drop(*_BUCKET).groupBy("chunk")).applyInArrow(
        rate, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def score_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with the documents labelled as of quality 1 as target."""
    return score(docs, labels.filter("quality = 1"))
