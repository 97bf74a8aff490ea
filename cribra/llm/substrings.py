"""Repeated word sequences by difference-cover anchors.

A difference cover modulo a period holds, for every two places, a shift under the
period that moves both to cover positions.  So two equal windows of ``window`` words
share an aligned anchor: equal sequences of ``window - period + 1`` words that start
at cover positions of both.  Only anchors at cover positions are hashed and counted;
those that occur once end there.  Around the others every window that contains the
anchor is hashed whole (96 bits) and counted, which extends the match.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import persist_shared

#: Difference covers by period (fixed values: the smallest ones).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 18

_U = np.uint64
_BYTES, _WORDS, _MORE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def period_for(window: int) -> int:
    """The largest period that leaves an anchor of two fifths of the window."""
    return max(p for p in COVERS if p == 1 or 5 * (window - p + 1) >= 2 * window)


@lru_cache(maxsize=6)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _rolling(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair: a polynomial modulo 2 ** 64 in the odd
    ``base``, whose inverse powers move every sequence to the same place."""
    size = 1 << max(10, int(len(values)).bit_length())
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(base, size)[:len(values)], out=sums[1:])
    x = (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), size)[starts]
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and the place of each text's first word."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    hashes = _rolling(data.astype(_U) + _U(1), _BYTES, starts, ends) if len(starts) else np.zeros(0, _U)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, at)


def _chunks(column: pa.Array, most: int):
    """``(first row, texts)`` in pieces of about ``most`` bytes; null is empty."""
    first, size, texts = 0, 0, []
    for i, t in enumerate(column):
        t = t.as_py() or b""
        if texts and size + len(t) > most:
            yield first, texts
            first, size, texts = i, 0, []
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def _places(firsts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in it of every word."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return text, np.arange(total) - firsts[text]


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """``h, row, at``: anchors of texts that have a window."""
    period = period_for(window)
    long, cover = window - period + 1, np.isin(np.arange(period), COVERS[period])

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, pieces in _chunks(batch.column(1), CHUNK):
                hashes, firsts = word_hashes(pieces)
                text, at = _places(firsts, len(hashes))
                n = np.diff(firsts)[text]
                i = np.flatnonzero(cover[at % period] & (at + long <= n) & (n >= window))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_rolling(hashes, _WORDS, i, i + long).view(np.int64)),
                     pa.array(rows[first + text[i]]), pa.array(at[i].astype(np.int32))], ["h", "row", "at"])

    return texts.select("row", F.col("text").cast("binary")).mapInArrow(run, "h long, row long, at int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``f, g, row, start, many``: windows around the anchors ``at`` of each text."""
    reach = period_for(window) - 1

    def run(batches):
        for batch in batches:
            rows, anchors, many = batch.column(0).to_numpy(), batch.column(2), np.array(batch.column(3))
            for first, pieces in _chunks(batch.column(1), CHUNK):
                hashes, firsts = word_hashes(pieces)
                starts = []
                for k in range(len(pieces)):
                    at = anchors[first + k].values.to_numpy()
                    n = firsts[k + 1] - firsts[k] - window + 1
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.maximum(at - reach, 0), 1)
                    np.add.at(edge, np.minimum(at + 1, n), -1)
                    starts.append(firsts[k] + np.flatnonzero(np.cumsum(edge[:-1]) > 0))
                i = np.concatenate(starts)
                text = np.repeat(np.arange(len(pieces)), [len(s) for s in starts])
                for part in np.array_split(np.arange(len(i)), max(1, len(i) >> 16)):
                    j, t = i[part], text[part]
                    f, g = (_rolling(hashes, base, j, j + window) for base in (_WORDS, _MORE))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32)),
                         pa.array(rows[first + t]), pa.array((j - firsts[t]).astype(np.int32)),
                         pa.array(many[first + t])], ["f", "g", "row", "start", "many"])

    return texts.select("row", F.col("text").cast("binary"), "at", "many").mapInArrow(
        run, "f long, g int, row long, start int, many boolean")


def _repeated(found: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """Keys of ``found`` that occur again, or for which ``more``, an aggregate, holds.
    Counts are summed before the shuffle, and partitions of a join with the keys can be
    split, so a key may hold any share of the rows."""
    again = persist_shared(found.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias("n"), more.alias("more"))
                                .filter("n OR more").select(*keys), "repeated")
    return again.hint("shuffle_hash")


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """``texts(row, doc_id, text)``, written once, and ``marks(row, starts, copy)``: for
    every row that has them the places (in words, 0-based, ascending) of its windows of
    ``window`` words whose sequence also starts elsewhere, in the same text or another.

    Rows whose whole text occurs again have ``copy`` instead: all their windows repeat.
    Only the first of such rows meets the others, for all of them.
    """
    texts = persist_shared(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text",
        F.unhex(F.md5("text")).alias("digest")), "texts", compression="zstd")
    # written, so that the join deals both sides anew and can split a large group of copies
    groups = persist_shared(
        texts.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 AND digest IS NOT NULL").select("digest", "first"), "groups")
    copies = persist_shared(texts.select("row", "digest").join(groups, "digest")
                            .select("row", (F.col("row") == F.col("first")).alias("first")), "copies")

    anchors = _anchors(texts, window)
    near = anchors.join(_repeated(anchors, ["h"], F.lit(False)), "h") \
        .groupBy("row").agg(F.collect_list("at").alias("at")) \
        .join(copies, "row", "left").filter("first IS NULL OR first") \
        .select("row", "at", F.col("first").isNotNull().alias("many"))
    windows = persist_shared(_windows(texts.join(persist_shared(near, "anchored"), "row"), window), "windows")
    keys = ["f", "g"]
    starts = windows.filter("NOT many").join(_repeated(windows, keys, F.max("many")), keys) \
        .groupBy("row").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    marks = starts.select("row", "starts", F.lit(False).alias("copy")).unionByName(
        copies.select("row", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    return texts.drop("digest"), persist_shared(marks, "marks")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs(doc_id, text)``.

    Words are cut at ASCII white space and compared as they are.  Every word that a
    repeated window covers goes; ``kept`` joins the others by one space.  Windows are
    judged on the input, so all copies of a passage go, the first one too.

    Null and empty texts have no words; texts of fewer than ``window`` words stay.
    Repeated rows are texts of their own, so each makes the other's windows repeat; a
    null doc_id is kept as it is.  Other columns are ignored; an empty table gives no
    rows.
    """
    texts, marks = repeated_windows(docs, window)

    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, at, copy in zip(*batch.columns[1:]):
                words = (text.as_py() or b"").split()  # bytes: ASCII white space only
                total.append(len(words))
                if copy.as_py() and len(words) >= window:
                    words = []
                elif at.is_valid and len(at):
                    edge = np.zeros(len(words) + 1, np.int64)
                    i = at.values.to_numpy()
                    edge[i] += 1
                    edge[i + window] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(marks, "row", "left").select("doc_id", F.col("text").cast("binary"), "starts", "copy") \
        .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary") \
        .withColumn("kept", F.col("kept").cast("string"))


#: The same in DuckDB: every window of 35 words.
REPEATS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, unnest(range(1, len(w) - 33)) AS s FROM t WHERE len(w) >= 35),
h AS (SELECT i.r, i.s, md5(array_to_string(t.w[i.s:i.s + 34], ' ')) AS h FROM i JOIN t USING (r)),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM h WHERE h IN (SELECT h FROM again)),
k AS (SELECT t.r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
o AS (SELECT k.r, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n
      FROM k LEFT JOIN gone ON gone.r = k.r AND gone.p = k.p WHERE gone.p IS NULL GROUP BY k.r)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(o.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(o.kept, '')) AS kept_sha256
FROM t LEFT JOIN o USING (r)
"""
