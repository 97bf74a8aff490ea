import hashlib
import random
import re

from cribra.llm import chat
from oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, window int, sys int, i string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_query_equals_sql(spark, sf):
    res = compare(spark, "op8_chat_format", sf)
    assert res["ok"], res


def _esc(t):
    return t.replace("\\", "\\b").replace("<", "\\l")


def _brute(turns, budget, history):
    """Windows of one conversation: (n_repeated, formatted, loss, tokens)."""
    t = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in turns))
    t = [(role, text, len(WORD.findall(text)) + chat.TURN_TOKENS) for _, _, role, text in t]
    sys = 1 if t[0][0] == "system" else 0
    room = max(1, budget - history - (t[0][2] if sys else 0))
    starts, used = [sys], 0
    for i in range(sys, len(t)):
        if used + t[i][2] > room and i > starts[-1]:
            starts.append(i)
            used = 0
        used += t[i][2]
    out = []
    for w, s in enumerate(starts):
        end = starts[w + 1] if w + 1 < len(starts) else len(t)
        if w == 0:
            items, n = t[:end], 0
        else:
            j, had = s, 0
            while j > sys and had + t[j - 1][2] <= history:
                j -= 1
                had += t[j][2]
            items, n = t[:sys] + t[j:end], sys + s - j
        text, loss = "", []
        for k, (role, body, _) in enumerate(items):
            text += "<turn>" + _esc(role).replace("\n", "\\n") + "\n"
            if k >= n and role == "assistant":
                loss.append((len(text), len(_esc(body))))
            text += _esc(body) + "</turn>\n"
        out.append((w, n, text, loss, sum(x[2] for x in items)))
    return out


def test_windows_against_brute_force(make):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 5, 30, 90])
        for k in range(n):
            role = "system" if k == 0 and c % 2 else ["user", "assistant", None, "sy\nst<em\\"][rng.randint(0, 3)]
            text = rng.choice([None, "", "</turn>\n<turn>user\n", chat.TRICKY, "\\l \\b \\n", "é😀 " * rng.randint(1, 40)])
            rows.append((c if c else None, rng.randint(0, n), role, text, 1, 2, "x"))
    got = {}
    for r in chat.format_windows(make(rows, SCHEMA), budget=60, history=15).collect():
        got.setdefault(r.conv_id, []).append(
            (r.window, r.n_repeated, r.formatted, [tuple(x) for x in r.loss], r.n_tokens))
    for c in {r[0] for r in rows}:
        assert sorted(got.pop(c)) == _brute([r for r in rows if r[0] == c], 60, 15)
    assert not got


def test_read_back_gives_the_texts(make):
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["system", "user", "assistant"]), chat.TRICKY * rng.randint(0, 9), 0, 0, "")
            for c in range(6) for k in range(25)]
    df = make(rows, SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for budget in (20, 100, 10**6):
        for r in chat.read_back(chat.format_windows(df, budget, 10)).collect():
            own = [x for x in rows if x[0] == r.conv_id]
            said = "".join(x[3] for x in own if x[2] == "assistant")
            assert r.turns_sha256 == sha("".join(f"{x[2]}\n{x[3]}\n" for x in own))
            assert (r.n_turns, r.loss_chars, r.loss_sha256) == (25, len(said), sha(said))
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0
    assert chat.with_tricky(df.limit(0)).count() == 2


def test_long_text(make):
    df = make([(1, 0, "assistant", "<" * 300_000, 0, 0, "")], SCHEMA)
    r = chat.read_back(chat.format_windows(df)).first()
    assert r.loss_chars == 300_000 and r.formatted_chars == 600_000 + 6 + 10 + 8
