"""Secret scans: wide candidate rules, then a random forest that removes false positives.

The rules find values behind an assignment, strings with a well-known prefix and
long mixed strings.  A forest trained on labelled findings judges each candidate by
its length, character classes and transitions, dictionary coverage, path shape and
the words around it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of the context on either side of a candidate.
CONTEXT = 60
#: Bounds of the training set: documents whose text lends its words and hashes,
#: code points of each (a window at a seeded place), dictionary words.
SAMPLE_DOCS, WINDOW_CHARS, DICTIONARY = 400, 2000, 5000
TREES, DEPTH, LEAF = 40, 10, 4
#: Mean vote from which on a candidate is a secret.
THRESHOLD = 0.5
MASK = "<secret>"

_ASSIGNED = re.compile(r"""[:=]>?[ \t]{0,3}["'`]?([^\s"'`,;<>(){}\[\]]{8,})""")
_KNOWN = re.compile(r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}"""
                    r"""|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}"""
                    # tried once for each run of its characters, so that long runs cost no more
                    r"""|(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+)""")
_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----")
_HEADER = re.compile(r"[A-Za-z0-9-]+:.*")
_BASE64 = re.compile(r"[A-Za-z0-9+/=\\]*")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
_SECRET_WORDS = re.compile(r"(?i)passw|pwd|secret|token|api.?key|access.?key|private|credential|auth|bearer|signing")
_PLAIN_WORDS = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your|commit|checksum|digest|sha\d|md5|etag"
                          r"|uuid|guid|version|revision|hash|build|mail|phone|http|www|file|path|card|order|date")
_EXTENSION = re.compile(r"\.[A-Za-z]{1,5}\d?$")


def _is_key_body(body: str) -> bool:
    """Header lines, then lines of base64 (a backslash stands for an escaped line end)."""
    head = True
    for line in body.split("\n"):
        line = line.strip()
        if _BASE64.fullmatch(line):
            head = head and not line
        elif not head or not _HEADER.fullmatch(line):
            # a wrapped header value goes on with a blank, others end the block
            return False
    return True


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from BEGIN to END, of any length; a BEGIN line without one alone.

    One pass over the marks, and each body is read once.
    """
    edges = list(_EDGE.finditer(text)) if "PRIVATE KEY-----" in text else []
    out = []
    for a, b in zip(edges, [*edges[1:], None]):
        if a[1] == "BEGIN":
            whole = b is not None and b[1] == "END" and _is_key_body(text[a.end():b.start()])
            out.append((a.start(), b.end() if whole else a.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, rule)`` of every candidate, in order, without overlaps.

    Where rules overlap, a known shape wins over an assigned value and that over a
    long mixed string.
    """
    keys = key_blocks(text)
    found = [(s, e, "known") for s, e in keys]
    at = 0
    for m in _KNOWN.finditer(text):
        while at < len(keys) and keys[at][1] <= m.start():
            at += 1
        if at == len(keys) or keys[at][0] >= m.end():
            found.append((m.start(), m.end(), "known"))
    found += [(m.start(1), m.end(1), "assigned") for m in _ASSIGNED.finditer(text)]
    found += [(m.start(), m.end(), "mixed") for m in _MIXED.finditer(text)
              if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    rank = {"known": 0, "assigned": 1, "mixed": 2}
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for rule in rank:
        spans = [f for f in found if f[2] == rule]
        fresh, at = [], 0
        for s, e, _ in spans:
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at == len(taken) or taken[at][0] >= e:
                fresh.append((s, e))
        out += [(s, e, rule) for s, e in fresh]
        taken = sorted(taken + fresh)
    return sorted(out)


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, longest match first."""
    v = value.lower()
    i = covered = 0
    while i < len(v):
        for n in range(min(12, len(v) - i), 2, -1):
            if v[i:i + n] in words:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, sum(c.isalpha() for c in v))


def features(before: str, value: str, after: str, words: frozenset[str],
             odds: dict[str, float] | None = None) -> list[float]:
    odds = odds or {}
    n = len(value)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = Counter(kind)
    count = Counter(value)
    steps = sum(a != b for a, b in zip(kind, kind[1:]))
    runs = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:]))
    line = before.rpartition("\n")[2]
    near = line[-30:]
    return [
        math.log(n), share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n,
        steps / max(1, n - 1), runs / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in count.values()), len(count) / n,
        _coverage(value, words),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(value.count("/")), float(value.count(".")), float(value.count("-") + value.count("_")),
        float(value[:1] in "/.~" or "://" in value or "@" in value), float(bool(_EXTENSION.search(value))),
        float(bool(_SECRET_WORDS.search(near))), float(bool(_PLAIN_WORDS.search(near))),
        float(bool(_PLAIN_WORDS.search(value))), float(bool(_SECRET_WORDS.search(line))),
        float(near.rstrip("\"'` \t")[-1:] in ("=", ":", ">")), float(before[-1:] in "\"'`" and after[:1] in "\"'`"),
        float(bool(_KNOWN.match(value))), float(bool(_EDGE.match(value))), float(value.count("\n")),
        *_lean(line, odds)]


#: Findings that a word or word pair must stand in front of before it counts, and words
#: looked at.
WORD_FINDINGS, NEAR_WORDS = 20, 3


def _near(line: str) -> list[str]:
    """The last words of a line, lower-cased, and their neighbouring pairs."""
    w = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", line[-40:])][-NEAR_WORDS:]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _lean(line: str, odds: dict[str, float]) -> list[float]:
    """Least, greatest and last log odds of the words and pairs before a candidate."""
    own = [odds.get(w, 0.0) for w in _near(line)] or [0.0]
    return [min(own), max(own), sum(own)]


def word_odds(findings: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Log odds of a secret after each word or pair that precedes enough findings, less
    those of all findings: 0 says nothing."""
    seen: dict[str, list[int]] = {}
    for before, _, _, secret in findings:
        for w in set(_near(before.rpartition("\n")[2])):
            seen.setdefault(w, [0, 0])[secret] += 1
    secrets = sum(f[3] for f in findings)
    base = math.log((secrets + 1) / (len(findings) - secrets + 1))
    return {w: math.log((n[1] + 1) / (n[0] + 1)) - base for w, n in seen.items() if sum(n) >= WORD_FINDINGS}


class Forest:
    """Random forest of binary trees on bootstrap samples (Gini impurity)."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 0):
        self.size, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.trees = []
        for _ in range(self.size):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, cut, left, right, share of secrets
            self._grow(x[rows], y[rows], 0, nodes, rng)
            a = np.array(nodes)
            self.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, float(y.mean())])
        if depth == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24)))
            left = x[:, f, None] <= cuts
            nl = left.sum(axis=0)
            nr = len(y) - nl
            pl = (left * y[:, None]).sum(axis=0)
            pr = y.sum() - pl
            with np.errstate(divide="ignore", invalid="ignore"):
                gini = np.where((nl >= self.leaf) & (nr >= self.leaf),
                                pl * (1 - pl / nl) + pr * (1 - pr / nr), np.inf)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (gini[k], f, cuts[k])
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        left = self._grow(x[go], y[go], depth + 1, nodes, rng)
        right = self._grow(x[~go], y[~go], depth + 1, nodes, rng)
        nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                go = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += share[at]
        return total / max(1, len(self.trees))


class Judge:
    """A forest with its dictionary and the log odds of the words before a finding."""

    def __init__(self, forest: Forest, words: frozenset[str], odds: dict[str, float] | None = None):
        self.forest, self.words, self.odds = forest, words, odds or {}

    def vote(self, findings: list[tuple]) -> np.ndarray:
        """Mean vote on findings ``(before, value, after, ...)``."""
        return self.forest.score(np.array([features(*f[:3], self.words, self.odds) for f in findings]))

    def findings(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(start, end, rule, score)`` of every candidate of a text."""
        spans = candidates(text)
        if not spans:
            return []
        votes = self.vote([(text[max(0, s - CONTEXT):s], text[s:e], text[e:e + CONTEXT]) for s, e, _ in spans])
        return [(*span, float(p)) for span, p in zip(spans, votes)]


def train(findings: list[tuple[str, str, str, int]], words: frozenset[str], seed: int = 0) -> Judge:
    """A judge from labelled findings ``(before, value, after, is_secret)``."""
    odds = word_odds(findings)
    x = np.array([features(b, v, a, words, odds) for b, v, a, _ in findings])
    y = np.array([f[3] for f in findings], float)
    return Judge(Forest(seed=seed).fit(x, y), words, odds)


def labelled_findings(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[list[tuple], frozenset[str]]:
    """Labelled findings and a dictionary, made of a bounded sample of ``docs``.

    ``sample`` documents (by a hash of doc_id) lend the words around a finding and
    the words and hashes it is made of: secrets are hashes of the text in the usual
    places, the others are what rules hit by mistake (checksums, identifiers, paths,
    addresses, placeholders, plain words).  A caller with labelled findings of their
    own passes those to ``train``.
    """
    n = docs.filter("text IS NOT NULL").count()
    if not n:
        return [], frozenset()
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)),
                   F.greatest(F.lit(1), F.length("text") - WINDOW_CHARS)).cast("int") + 1
    some = docs.filter("text IS NOT NULL").filter(
        F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) <= 1.5 * sample / n * (1 << 30)) \
        .select(F.substr("text", place, F.lit(WINDOW_CHARS)).alias("t"), F.sha2("text", 512).alias("h")) \
        .limit(2 * sample)
    hexes = lambda lo, k: F.substr("h", F.lit(lo), F.lit(k))
    b64 = F.base64(F.unhex(F.col("h")))
    some = some.select(
        "t", hexes(1, 40).alias("x40"), hexes(41, 32).alias("x32"), hexes(60, 64).alias("x64"),
        F.regexp_replace(b64, "[+/=\\s]", "").alias("b"), b64.alias("b64"),
        F.upper(F.regexp_replace(b64, "[+/=\\s]", "")).alias("u"))
    rows = sorted(map(tuple, some.collect()))[:sample]
    count = Counter(w for r in rows for w in re.findall(r"[a-z]{3,12}", r[0].lower()))
    words = frozenset(w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:DICTIONARY])
    rng, shapes = np.random.default_rng(0), np.random.default_rng(1)
    out = []
    for t, x40, x32, x64, b, b64s, u in rows:
        parts = t.split() or ["a"]
        at = int(rng.integers(0, len(parts)))
        left, right = " ".join(parts[max(0, at - 8):at]) + " ", " " + " ".join(parts[at:at + 8])
        low = [w for w in re.findall(r"[a-z]{3,}", t.lower())] or ["word"]
        a, c, e = (low[int(k)] for k in rng.integers(0, len(low), 3))
        num = str(int(rng.integers(10**9, 10**15)))
        d = x64
        uuid = f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}"
        quote = str(rng.choice(['"', "'", ""]))
        name = str(rng.choice(["token", "api_key", "secret", "auth_token", "access_key", "client_secret"]))
        op = str(rng.choice([" = ", "=", ": ", ":"]))
        kind, lines = str(shapes.choice(["", "RSA ", "EC ", "ENCRYPTED ", "OPENSSH "])), int(shapes.integers(1, 30))
        head = str(shapes.choice(["", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{x32.upper()}\n\n"]))
        yes = [(f"{name}{op}{quote}", v, quote) for v in (x40, x32, b[:24], b[:40], b64s[:44])]
        yes += [(f"password{op}{quote}", b[:12], quote), (f"{a}_pwd{op}{quote}", b[3:13] + "!", quote),
                ("", "AKIA" + u[:16], ""), ("", "ghp_" + b[:36], ""), ("sk ", "sk-" + b[:32], ""),
                ("Authorization: Bearer ", b[:40], ""), ("", "eyJ" + b[:20] + "." + b[20:44] + "." + b[44:70], ""),
                (f"{a}:", "xoxb-" + num + "-" + b[:24], ""),
                ("", f"-----BEGIN {kind}PRIVATE KEY-----\n{head}" + "\n".join([b64s[:64]] * lines)
                 + f"\n-----END {kind}PRIVATE KEY-----", "")]
        no = [("commit ", x40, ""), ("sha256: ", x64, ""), ("md5=", x32, ""), ("etag: \"", x32, "\""), ("checksum = ", x40, ""),
              ("id: ", uuid, ""), ("uuid=", uuid, ""), (f"{name}{op}{quote}", f"{a}_{c}", quote), (f"{name}{op}{quote}", f"{a}{c}{e}", quote),
              (f"password{op}", f"{a}{c}1", ""), (f"{name}{op}{quote}", f"your_{name}_here", quote), (f"{name}{op}", "x" * 16, ""),
              (f"password{op}", "changeme123", ""), (f"{name}{op}", "1234567890abcdef", ""), (f"{name}{op}", "0" * 32, ""),
              ("", f"/usr/{a}/{c}/{e}.so.1.2", ""), ("see: ", f"https://www.{a}.com/{c}/{num}", ""), ("", f"{a}/{c}/{e}_{num[:4]}.tar.gz", ""),
              ("version: ", f"{num[0]}.{num[1]}.{num[2:4]}-{a}.{num[4:10]}", ""), ("date: ", f"20{num[:2]}-0{num[2]}-1{num[3]}T10:00:00", ""),
              ("mail: ", f"{a}.{num[:2]}@mail1.example.com", ""), ("phone: ", f"+1-{num[:3]}-{num[3:6]}-{num[:4]}", ""),
              (f"{a} ", f"-----BEGIN {kind}PRIVATE KEY-----", f" {c}"), ("order: ", num, ""), (f"{a}: ", f"{c}{e}{a}", ""), ("", f"{a}-{c}-{e}-{num[:3]}-{a}", ""), (f"{a}=", f"{c}_{e}_{num[:2]}", "")]
        out += [(left + p, v, q + right, 1) for p, v, q in yes] + [(left + p, v, q + right, 0) for p, v, q in no]
    return out, words


def fit(docs: DataFrame) -> Judge | None:
    """A judge trained on findings made of ``docs``; None without any text."""
    found, words = labelled_findings(docs)
    return train(found, words) if found else None


def scan(docs: DataFrame, judge: Judge | None) -> DataFrame:
    """Every candidate of every whole text, one row each: ``doc_id, start, length``
    (code points), ``rule, value_sha256, score, is_secret``.

    Null and empty texts give no rows; repeated rows repeat their findings; other
    columns are ignored.  Without a judge (nothing to learn from) there is no text
    and hence no finding.
    """
    shared = docs.sparkSession.sparkContext.broadcast(judge)  # bounded by TREES, DEPTH, DICTIONARY

    def run(batches):
        j = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, e, rule, p in (j.findings(text) if text and j else ()):
                    sha = hashlib.sha256(text[s:e].encode("utf-8", "replace")).hexdigest()
                    rows.append((doc, s, e - s, rule, sha, p, p >= THRESHOLD))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            names = ["doc_id", "start", "length", "rule", "value_sha256", "score", "is_secret"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, rule string, value_sha256 string, "
             "score double, is_secret boolean")


def redacted(judge: Judge | None, docs: DataFrame) -> Column:
    """Column ``text`` of ``docs`` with every secret replaced by MASK; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        j = shared.value

        def one(text):
            if not text or j is None:
                return text
            out, at = [], 0
            for s, e, _, p in j.findings(text):
                if p >= THRESHOLD:
                    out += [text[at:s], MASK]
                    at = e
            return "".join(out) + text[at:] if out else text

        for texts in batches:
            yield texts.map(one)

    return clean(F.col("text"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked and n_chars, if there is one, counted anew for
    changed texts.  All rows and columns stay."""
    out = docs.withColumn("text", redacted(fit(docs), docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").contains(MASK), F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out
