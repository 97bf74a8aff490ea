"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word's UTF-8 bytes from both ends and labels every byte; a
document's language is the mean of the labels of all its bytes.  State starts anew
at each word, so a word's labels never change and each distinct word is read once
per batch of texts.  Training (back-propagation through time, numpy) runs on the
driver over a bounded sample; prediction runs over whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bound of the training sample: documents per language, code points of each (a
#: window at a seeded place), and documents of all languages.  Every language is
#: learned; with many of them each gives fewer documents.
DOCS_PER_LANG, WINDOW_CHARS, SAMPLE_DOCS = 250, 4000, 50_000
#: Rows a language needs to give some for calibration, how many it gives, and the
#: words of the pieces that are read besides their whole texts.
CALIBRATE_FROM, CALIBRATE_DOCS, FRAGMENTS = 20, 200, (1, 2, 4, 8, 16, 32)
HIDDEN, STEPS, BATCH, RATE = 16, 1500, 256, 0.01
#: A longer word is read in pieces of so many bytes.
PIECE = 48
#: Distinct words that a worker remembers; code points it splits at a time.
WORD_TABLE, CHUNK_CHARS = 100_000, 1_000_000
#: Bytes read at a time: bounds the network's states, however long the words are.
POSITIONS = 1 << 16


class Network:
    """Gated recurrent units in both directions and a softmax per byte."""

    def __init__(self, n_langs: int, hidden: int = HIDDEN, seed: int = 0, dtype=np.float32):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(dtype)  # byte -> gates
            self.p[f"u{d}"] = rng.normal(0, h ** -0.5, (h, 3 * h)).astype(dtype)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, n_langs)).astype(dtype)
        self.p["c"] = np.zeros(n_langs, dtype)

    def _read(self, x: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each step for gate inputs ``x`` (steps, words, 3h)."""
        steps, n, _ = x.shape
        h = self.h
        out = np.empty((steps, n, h), x.dtype)
        s = np.zeros((n, h), x.dtype)
        for t in range(steps):
            g = s @ u
            zr = 0.5 * np.tanh(0.5 * (x[t, :, :2 * h] + g[:, :2 * h])) + 0.5
            z, r = zr[:, :h], zr[:, h:]
            m = np.tanh(x[t, :, 2 * h:] + r * g[:, 2 * h:])
            if keep is not None:
                keep.append((s, z, r, m, g[:, 2 * h:]))
            s = m + z * (s - m)
            out[t] = s
        return out

    def label(self, words: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities (length, words, langs) for equally long words
        ``words`` (words, length) of bytes."""
        w = words.T
        sides = []
        for d, seq in (("f", w), ("b", w[::-1])):
            tape = [] if keep is not None else None
            out = self._read(self.p[f"x{d}"][seq], self.p[f"u{d}"], tape)
            sides.append(out if d == "f" else out[::-1])
            if keep is not None:
                keep[d] = tape
        both = np.concatenate(sides, axis=2)
        score = both @ self.p["o"] + self.p["c"]
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        if keep is not None:
            keep["both"] = both
        return score

    def gradients(self, words: np.ndarray, langs: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy per byte and its gradients."""
        keep: dict = {}
        prob = self.label(words, keep)
        steps, n, _ = prob.shape
        cols = np.arange(n)
        loss = -float(np.log(prob[:, cols, langs] + 1e-12).mean())
        d = prob.copy()
        d[:, cols, langs] -= 1
        d /= steps * n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"] = np.einsum("tnh,tnc->hc", keep["both"], d)
        grad["c"] = d.sum(axis=(0, 1))
        back = d @ self.p["o"].T
        h = self.h
        w = words.T
        for side, seq, ds in (("f", w, back[:, :, :h]), ("b", w[::-1], back[::-1, :, h:])):
            u = self.p[f"u{side}"]
            dx = np.empty((steps, n, 3 * h), back.dtype)
            du = np.zeros_like(u)
            carry = np.zeros((n, h), back.dtype)
            for t in reversed(range(steps)):
                s, z, r, m, gm = keep[side][t]
                now = ds[t] + carry
                dm = now * (1 - z) * (1 - m * m)
                dz = now * (s - m) * z * (1 - z)
                dr = dm * gm * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dm], axis=1)
                dg = np.concatenate([dz, dr, dm * r], axis=1)
                du += s.T @ dg
                carry = now * z + dg @ u.T
            grad[f"u{side}"] = du
            np.add.at(grad[f"x{side}"], seq, dx)
        return loss, grad


def train(words: list[bytes], langs: np.ndarray, n_langs: int, steps: int = STEPS,
          seed: int = 0) -> Network:
    """Adam on batches of equally long words, each language as often as the others."""
    rng = np.random.default_rng(seed)
    net = Network(n_langs, seed=seed)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    share = 1.0 / np.maximum(1, np.bincount(langs, minlength=n_langs))[langs]
    groups = []
    for length, members in sorted(by_length.items()):
        rows = np.array(members)
        text = np.frombuffer(b"".join([words[i] for i in members]), np.uint8).reshape(-1, length)
        p = share[rows]
        groups.append((text, langs[rows], p / p.sum(), p.sum() * length ** 0.5))
    weight = np.array([g[3] for g in groups])
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        text, lang, p, _ = groups[rng.choice(len(groups), p=weight / weight.sum())]
        pick = rng.choice(len(text), BATCH, p=p)
        _, grad = net.gradients(text[pick], lang[pick])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def _pieces(word: bytes) -> list[bytes]:
    return [word[i:i + PIECE] for i in range(0, len(word), PIECE)]


def _counts(known: DataFrame) -> dict[str, int]:
    """Rows of each language; raises beyond SAMPLE_DOCS languages."""
    rows = known.groupBy("lang").count().orderBy("lang").limit(SAMPLE_DOCS + 1).collect()
    if len(rows) > SAMPLE_DOCS:
        raise ValueError(f"more than {SAMPLE_DOCS} languages: the lang column holds something else")
    return {r["lang"]: r["count"] for r in rows}


def _share(n: int, per_lang: int) -> int:
    """Documents that each of ``n`` languages may give."""
    return min(per_lang, SAMPLE_DOCS // max(1, n))


def _window() -> Column:
    """WINDOW_CHARS code points of the text from a place by a hash of doc_id."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)),
                   F.greatest(F.lit(1), F.length("text") - WINDOW_CHARS)).cast("int") + 1
    return F.substr("text", place, F.lit(WINDOW_CHARS)).alias("text")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame) -> tuple[Network | None, list[str]]:
    """Learns from a bounded sample of ``docs(doc_id, text, lang)``.

    Every language gives about DOCS_PER_LANG documents, chosen by a hash of doc_id,
    and of each a window of WINDOW_CHARS code points at a hashed place.  Rows with a
    null text or lang are left out.  Without any row the model is None.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = _counts(known)
    if not counts:
        return None, []
    langs = sorted(counts)
    each = _share(len(langs), DOCS_PER_LANG)
    shares = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, each / counts[lang])) for lang in langs], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang") \
        .filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30)) \
        .select("lang", _window()).limit(2 * each * len(langs)).collect()
    number = {lang: i for i, lang in enumerate(langs)}
    words, ids = [], []
    for lang, text in sorted((r["lang"], r["text"]) for r in sample):
        for w in text.split():
            for piece in _pieces(w.encode()):
                words.append(piece)
                ids.append(number[lang])
    if not words:
        return None, []
    return train(words, np.array(ids), len(langs)), langs


class Reader:
    """Predicts texts; remembers the labels of words it has read."""

    def __init__(self, net: Network, langs: list[str]):
        self.net, self.langs = net, langs
        self.table: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Adds the summed labels (and byte count) of new words to the table."""
        pieces = [(i, p) for i, w in enumerate(words) for p in _pieces(w.encode("utf-8", "replace"))]
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in pieces:
            by_length.setdefault(len(p), []).append((i, p))
        new = np.zeros((len(words), len(self.langs) + 1), np.float32)
        for length, group in by_length.items():
            size = max(1, POSITIONS // length)
            for at in range(0, len(group), size):
                part = group[at:at + size]
                text = np.frombuffer(b"".join([p for _, p in part]), np.uint8).reshape(-1, length)
                np.add.at(new[:, :-1], [i for i, _ in part], self.net.label(text).sum(axis=0))
                np.add.at(new[:, -1], [i for i, _ in part], length)
        base = len(self.rows)
        self.table.update(zip(words, range(base, base + len(words))))
        self.rows = np.concatenate([self.rows, new])

    def sums(self, texts: list[str]) -> np.ndarray:
        """Summed labels and number of bytes of each text."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        words: list[str] = []
        ends = []
        for text in texts:
            words += text.split()
            ends.append(len(words))
        if len(self.table) > WORD_TABLE:
            self.table.clear()
            self.rows = self.rows[:0]
        new = list(set(words).difference(self.table))
        if new:
            self._learn(sorted(new, key=len))
        codes = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        full = np.flatnonzero(np.array(ends) > starts)
        if len(full):
            out[full] = np.add.reduceat(self.rows[codes], starts[full], axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its probability, and that less the runner-up's (alone: that itself)."""
        lang, score, margin = [], [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
                size += len(texts[end])
                end += 1
            s = self.sums(texts[at:end])
            at = end
            prob = s[:, :-1] / np.maximum(1, s[:, -1:])
            lang += [self.langs[i] for i in prob.argmax(axis=1)]
            score += np.clip(prob.max(axis=1), 0.0, 1.0).tolist()
            two = np.sort(prob, axis=1)[:, -2:]
            margin += np.clip(two[:, -1] - (two[:, 0] if two.shape[1] > 1 else 0.0), 0.0, 1.0).tolist()
        return lang, score, margin


def predict(docs: DataFrame, model: tuple[Network | None, list[str]]) -> Column:
    """Column ``struct<lang string, score double, margin double>`` for column ``text``
    of ``docs``; the margin is the score less the runner-up's.

    Null texts and texts without a letter give ``und`` and 0.0, as does a model that
    has learned nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 100 kB, by HIDDEN and SAMPLE_DOCS

    @F.pandas_udf("struct<lang string, score double, margin double>")
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        net, langs = shared.value
        reader = Reader(net, langs) if langs else None
        for text, letters in batches:
            out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0, "margin": 0.0}, index=text.index)
            real = letters.fillna(False).astype(bool)
            if reader is not None and real.any():
                for name, values in zip(out, reader.predict(text[real].tolist())):
                    out.loc[real, name] = values
            yield out

    text = F.col("text")
    return label(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text, lang)``.

    Learns from rows that are not held out (crc32 of the doc_id's text modulo 5 is
    not 0); a null doc_id is held out.  Repeated rows get equal results, an empty
    table gives none, other columns are ignored.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    model = fit(docs.select("doc_id", "text", "lang").filter(~out))
    return docs.select("doc_id", out.alias("held_out"), predict(docs, model).alias("p")) \
               .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def _cut(margin: np.ndarray, right: np.ndarray) -> float:
    """The margin at which keeping the texts from there on makes the fewest errors
    (wrong texts kept, right ones dropped), halfway in the gap below the next text."""
    order = np.argsort(margin, kind="stable")
    right = right[order].astype(np.int64)
    errors = np.concatenate([[0], np.cumsum(right)]) + np.concatenate([np.cumsum((1 - right)[::-1])[::-1], [0]])
    edges = np.append(margin[order], np.inf)
    edges[0] = 0.0
    first = np.append(True, edges[1:] > edges[:-1])  # equal margins are kept or dropped together
    at = int(np.where(first, errors, errors.max() + 1).argmin())
    return 0.0 if at == 0 else float(min(1.0, (edges[at - 1] + edges[at]) / 2))


def calibrate(model: tuple[Network | None, list[str]], sample: list[tuple[str, str]]) -> dict[str, float]:
    """The least margin to accept per language, from ``(lang, text)`` rows that were
    not trained on.

    Whole texts and pieces of FRAGMENTS words count as told right or wrong; each text
    joined to as many words of another language is one that cannot be told.  The cut
    makes the fewest errors on these.  It never exceeds the least margin of a language's own whole
    texts that are told right, so a language with close relatives keeps its texts.
    """
    net, langs = model
    sample = [(lang, text) for lang, text in sorted(sample) if text.strip()]
    if net is None or not sample:
        return {}
    texts, truth = [text for _, text in sample], [lang for lang, _ in sample]
    rng = np.random.default_rng(0)
    for lang, text in sample:
        w = text.split()
        for n in FRAGMENTS:
            if n < len(w):
                at = rng.integers(0, len(w) - n + 1)
                texts.append(" ".join(w[at:at + n]))
                truth.append(lang)
    by_lang = {lang: [text.split() for x, text in sample if x == lang] for lang in sorted({x for x, _ in sample})}
    for i, (lang, text) in enumerate(sample):
        others = [x for x in by_lang if x != lang]
        if others:
            pool = by_lang[others[i % len(others)]]
            w, v = text.split(), pool[i % len(pool)]
            n = min(len(w), len(v))
            texts.append(" ".join(w[:n] + v[:n]))
            truth.append(UNKNOWN)
    told, _, margin = Reader(net, langs).predict(texts)
    margin, right = np.array(margin), np.array([a == b for a, b in zip(told, truth)])
    cut = _cut(margin, right)
    whole = [(lang, m) for lang, m, ok in zip(truth[:len(sample)], margin, right) if ok]
    return {lang: min([cut, *(m for x, m in whole if x == lang)]) for lang in langs}


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: no text, no letter,
    or a margin to the runner-up under its language's cut (``calibrate``).  All columns
    stay.

    Languages with at least CALIBRATE_FROM labelled rows that are not held out give a
    tenth of them (by a hash of doc_id, at most about CALIBRATE_DOCS) to find the cuts;
    the network does not train on these.  Without such a row, or with one language
    only, there is nothing to compare and only texts without a letter go.  ``least``
    asks for that score instead of the calibrated margin.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    known = docs.select("doc_id", "text", "lang").filter(~out)
    if least is not None:
        model, enough = fit(known), lambda p: p["score"] >= least
    else:
        named = known.filter("text IS NOT NULL AND lang IS NOT NULL")
        counts = docs.sparkSession.createDataFrame(
            [(lang, n) for lang, n in _counts(named).items() if n >= CALIBRATE_FROM], "lang string, count long")
        apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0
        named = named.join(F.broadcast(counts), "lang", "left")  # at most SAMPLE_DOCS rows
        model = fit(named.filter(~(apart & F.col("count").isNotNull())).select("doc_id", "text", "lang"))
        each = _share(len(model[1]), CALIBRATE_DOCS)
        sample = named.filter(apart & F.col("count").isNotNull()) \
            .filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
                    < F.lit(10.0 * each) / F.col("count") * (1 << 30)) \
            .filter(F.col("text").rlike(r"\p{L}")) \
            .select("lang", _window()).limit(2 * each * max(1, len(model[1]))).collect()
        cuts = calibrate(model, [(r["lang"], r["text"]) for r in sample])
        cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]) if cuts else None
        enough = lambda p: F.lit(True) if cut is None else \
            p["margin"] >= F.coalesce(F.try_element_at(cut, p["lang"]), F.lit(0.0))
    name = "p"  # the text goes through the network as the row's own column, not beside it
    while name in docs.columns:
        name += "_"
    told = docs.select("*", predict(docs, model).alias(name))
    return told.filter((F.col(name)["lang"] != UNKNOWN) & enough(F.col(name))).drop(name)
