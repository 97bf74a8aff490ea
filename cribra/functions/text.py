"""Scalar text functions (survey F1-F10, F17, F18, F20) as Column expressions.

Everything here is a Catalyst expression: no Python runs per row, so these
functions stay inside whole-stage codegen and scale with the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.util import call, col_of, let

# The whitespace set of Python's ``str.split()``/``str.strip()``
# (29 code points).  Java's ``\s`` and Spark's ``trim`` know fewer, so one explicit
# class is used everywhere.
WS_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0),
             (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
             (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
WS_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: A run of it.  Java asks the ranges of a class one by one, so printable ASCII goes first.
WS_RUN = "[[^!-~]&&" + WS_CLASS + "]+"

# The prompt template of the generation step (three sections).
PROMPT_TEMPLATE = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n"
    "### Input:\n{input_text}\n\n"
    "### Response:\n{response}"
)

# End-of-text markers removed from crystal responses, and the
# record start marker.
END_MARKERS = ("</s>", "<|end_of_text|>")
RECORD_MARKER = "data_"


def strip_ws(c) -> Column:
    """strip Unicode whitespace at both ends (Python ``str.strip``)."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """F1 without the strip: whitespace runs to one blank.

    The pattern is slow, so a text of printable ASCII and common line ends does without:
    those become blanks, and each pass over pairs of blanks halves a run.
    """
    def short(s):
        out = s
        for ch in "\n\t\r":
            out = F.replace(out, F.lit(ch), F.lit(" "))
        for _ in range(3):
            out = F.replace(out, F.lit("  "), F.lit(" "))
        return let(out, lambda x: F.when(~F.contains(x, F.lit("  ")) & ~s.rlike("[^\t\n\r -~]"), x)
                   .otherwise(F.regexp_replace(s, WS_RUN, " ")))
    return let(col_of(c), short)


def normalize_ws(c) -> Column:
    """collapse whitespace runs to one blank and strip the ends."""
    return collapse_ws(strip_ws(c))


def remove_ws(c) -> Column:
    """remove all whitespace."""
    return F.regexp_replace(col_of(c), WS_RUN, "")


def tagged_block(c, begin: str, end: str) -> Column:
    """the block from the first ``begin`` to the first ``end`` after it.

    Either tag absent -> the whole stripped text.  When the only end tag comes
    before the begin tag the result is null (see ``tagged_block_error``).
    """
    v = strip_ws(c)
    start = F.instr(v, begin)
    stop = call("locate", F.lit(end), v, start)
    has_both = (start > 0) & (F.instr(v, end) > 0)
    block = strip_ws(call("substring", v, start, stop - start + F.lit(len(end))))
    return (F.when(~has_both, v)
            .when(stop > 0, block))


def tagged_block_error(c, begin: str, end: str) -> Column:
    """Error code of F3: ``bad_tag_order`` when no end tag follows the begin tag."""
    v = strip_ws(c)
    start = F.instr(v, begin)
    bad = (start > 0) & (F.instr(v, end) > 0) & (call("locate", F.lit(end), v, start) == 0)
    return F.when(bad, F.lit("bad_tag_order"))


def with_tagged_block(df: DataFrame, text: str, begin: str, end: str, block: str, error: str) -> DataFrame:
    """F3 over a DataFrame: adds ``tagged_block`` and ``tagged_block_error``; the stripped
    text and the places of the tags are columns first, so each is made once."""
    v, start = F.col("_text"), F.col("_start")
    out = df.select("*", strip_ws(text).alias("_text"))
    out = out.select("*", F.instr(v, begin).alias("_start"), F.instr(v, end).alias("_any"))
    both = (start > 0) & (F.col("_any") > 0)
    # 0: no end tag follows the begin tag; -1: not both tags are there
    out = out.select("*", F.when(both, call("locate", F.lit(end), v, start)).otherwise(F.when(v.isNotNull(), -1))
                     .alias("_stop"))
    stop = F.col("_stop")
    return out.select(
        *df.columns,
        F.when(stop < 0, v).when(stop > 0, strip_ws(call("substring", v, start, stop - start + F.lit(len(end)))))
         .alias(block),
        F.when(stop == 0, F.lit("bad_tag_order")).alias(error))


def cut_from_marker(c, marker: str = RECORD_MARKER, drop=END_MARKERS) -> Column:
    """remove end markers, then cut everything before the first ``marker``."""
    v = col_of(c)  # one strip at the end is enough: no marker holds whitespace
    for m in drop:
        v = F.replace(v, F.lit(m), F.lit(""))
    pos = F.instr(v, marker)
    return strip_ws(F.when(pos > 0, call("substring", v, pos)).otherwise(v))


def render_prompt(instruction, input_text, response=None,
                  template: str = PROMPT_TEMPLATE) -> Column:
    """fill the three-section template; the first two parts are stripped."""
    resp = F.lit("") if response is None else col_of(response)
    head, rest = template.split("{instruction}")
    mid, rest = rest.split("{input_text}")
    tail_a, tail_b = rest.split("{response}")
    return F.concat(F.lit(head), strip_ws(instruction), F.lit(mid),
                    strip_ws(input_text), F.lit(tail_a), resp, F.lit(tail_b))


def prompt_body(request_text, scaffold, hints=None) -> Column:
    """request text, blank line, stripped scaffold, optional blank line + hints."""
    parts = [col_of(request_text), strip_ws(scaffold)]
    if hints is not None:
        h = col_of(hints)
        parts.append(F.when(F.coalesce(h, F.lit("")) != "", h))
    return F.concat_ws("\n\n", *parts)


def safe_stem(c) -> Column:
    """F8: file-name-safe text; runs outside ``[A-Za-z0-9._-]`` become ``_``."""
    v = F.regexp_replace(strip_ws(F.coalesce(col_of(c), F.lit(""))),
                         r"[^A-Za-z0-9._-]+", "_")
    v = F.btrim(v, F.lit("._"))
    return F.when(v == "", F.lit("sample")).otherwise(v)


def join_keys(parts, sep: str = "|") -> Column:
    """join parts with ``sep``; a null part counts as the empty text."""
    return F.concat_ws(sep, *[F.coalesce(col_of(p), F.lit("")) for p in parts])


def json_list(c) -> Column:
    """array of strings -> JSON text the way Python's ``json.dumps`` writes
    it (``["a", "b"]``, blank after the comma, non-ASCII kept)."""
    items = F.transform(col_of(c),
                        lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def bool_text(c) -> Column:
    """booleans as ``True``/``False`` (null counts as false)."""
    return F.when(F.coalesce(col_of(c), F.lit(False)), F.lit("True")).otherwise(F.lit("False"))


def text_or_empty(c) -> Column:
    """value as text, null as the empty text."""
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def token_budget(prompt_len, max_len, max_new, margin: int = 16) -> Column:
    """tokens left for generation; null when the prompt leaves no room."""
    avail = col_of(max_len) - col_of(prompt_len) - F.lit(margin)
    return F.when(avail > 0, F.least(col_of(max_new), avail))


def token_budget_error(prompt_len, max_len, margin: int = 16) -> Column:
    """F20 error code: ``prompt_too_long`` instead of ending the job."""
    avail = col_of(max_len) - col_of(prompt_len) - F.lit(margin)
    return F.when(avail <= 0, F.lit("prompt_too_long"))


def int_text(c) -> Column:
    """Integer value of text the way Python's ``int(text)`` reads it (ASCII digits,
    optional sign, surrounding whitespace); null when it does not parse."""
    s = strip_ws(col_of(c))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
