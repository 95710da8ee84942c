"""Answer extraction and text cleaning as column expressions.

Every function maps Column -> Column: native expressions, but for the letters of ``clean_eval``, which
numpy takes over Arrow batches (``kernels``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K
from .text import NUMBER, SPACES, bound, col_, replace_if, strip, to_number

# Patterns whose meaning must match the source rules.
HASH_TAIL = r"####\s*([^\n\r]+)"          # text after the first '####' marker
HASH_LINE = r"####\s*[^\n\r]+"            # a '####' marker with its line
BOXED_INNER = r"\\boxed\s*\{\s*([^\}]+)\s*\}"
BOXED_OPEN = r"\\boxed\s*\{"
DEFAULT_LETTERS = "A-Za-zÆØÅæøå"


def _first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, NUMBER, 0), F.lit(""))


def _last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)),
                            F.lit(-1))


def gold_number_text(answer: str | Column) -> Column:
    """First number after the first '####' line, else the last number; as text
    with '.' as decimal point; null when there is no number."""
    a = col_(answer)
    tail = F.regexp_extract(a, HASH_TAIL, 1)
    picked = F.coalesce(_first_number(tail), _last_number(a))
    return F.replace(picked, F.lit(","), F.lit("."))


def gold_number(answer: str | Column) -> Column:
    """Gold answer as double (null when none)."""
    return gold_number_text(answer).try_cast("double")


def gold_text(answer: str | Column) -> Column:
    """Gold answer as text; falls back to the stripped text; null -> ''."""
    a = col_(answer)
    return F.when(a.isNull(), F.lit("")).otherwise(
        F.coalesce(gold_number_text(a), strip(a)))


def boxed_number(text: str | Column) -> Column:
    """First number inside the first non-empty \\boxed{...} (up to the first '}')."""
    inner = F.regexp_extract(col_(text), BOXED_INNER, 1)
    return to_number(_first_number(inner))


def boxed_flag(text: str | Column) -> Column:
    """C4: the text opens a \\boxed{ (null text counts as '')."""
    return F.coalesce(col_(text), F.lit("")).rlike(BOXED_OPEN)


def boxed_answer(answer: str | Column) -> Column:
    """Reasoning without '####' lines + a final \\boxed{gold} line."""
    s = strip(F.coalesce(col_(answer), F.lit("")))
    line = F.concat(F.lit("\\boxed{"), gold_text(s), F.lit("}"))
    body = strip(F.regexp_replace(s, HASH_LINE, ""))
    return F.when(body == "", line).otherwise(F.concat(body, F.lit("\n"), line))


def boxed_answer_en(answer: str | Column) -> tuple[Column, Column]:
    """Split on '####' into reasoning and final answer.

    Returns (response, rejected).  An answer with two or more '####' markers,
    or a null answer, is rejected (response null)."""
    a = col_(answer)
    parts = F.split(a, "####", -1)
    n = F.size(parts)
    final = F.when(n == 2, strip(F.element_at(parts, 2))).otherwise(F.lit(""))
    reasoning = F.when(n == 2, F.element_at(parts, 1)).otherwise(a)
    response = F.concat(strip(reasoning), F.lit("\n\\boxed{"), final, F.lit("}"))
    rejected = a.isNull() | (n > 2)
    return F.when(rejected, F.lit(None).cast("string")).otherwise(response), rejected


def clean_eval(text: str | Column, letters: str = DEFAULT_LETTERS) -> Column:
    """Text for language scoring in evaluation: drop boxed answers, LaTeX
    commands, digits and every non-letter; collapse whitespace; strip; lower."""
    t, known = F.coalesce(col_(text), F.lit("")), K.Letters.of(letters)
    return K.cleaned_letters(t, known, bare=True) if known else clean_letters(without_commands(t), letters)


def without_commands(text: Column) -> Column:
    """Boxed answers and LaTeX commands -> spaces."""
    s = F.regexp_replace(text, r"(?s)\\boxed\s*\{.*?\}", " ")
    return replace_if(s, "\\", r"\\[a-zA-Z]+", " ")


def clean_letters(text: Column, letters: str = DEFAULT_LETTERS) -> Column:
    """Digits, other signs and whitespace become spaces, and spaces collapse; strip; lower."""
    known = K.Letters.of(letters)
    return K.cleaned_letters(text, known) if known else F.lower(F.trim(letters_only(text, letters)))


def letters_only(text: Column, letters: str = DEFAULT_LETTERS) -> Column:
    """Every run of other characters -> one space.  A lone space is no match, as it stays what
    it is; replacing each would be most of the cost."""
    return F.regexp_replace(text, f"[^{letters} ][^{letters}]*| [^{letters}]+", " ")


def clean_reward(text: str | Column) -> Column:
    """Text for the language reward: drop code fences, $..$, \\[..\\], \\(..\\)
    and LaTeX commands with an optional {...} argument; strip."""
    s = F.coalesce(col_(text), F.lit(""))
    s = replace_if(s, "```", r"(?s)```.*?```", " ")
    s = bound(s, lambda v: F.when(v.contains("$") | v.contains("\\[") | v.contains("\\("), F.regexp_replace(
        v, r"(?s)(?=[$\\])(?:\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\))", " ")).otherwise(v))
    # (?d): '.' stops only at '\n', like the source dialect.
    s = replace_if(s, "\\", r"(?d)\\[a-zA-Z]+(?:\{.*?\})?", " ")
    return strip(s)


def drop_final_boxed(text: str | Column) -> Column:
    """Remove the last line when, stripped, it is \\boxed{...}.  One trailing
    line break after it is forgiven."""
    s = F.coalesce(col_(text), F.lit(""))
    blanks = SPACES.replace("\n", "")
    # a match holds no line feed but its first and its last character: only the last line is looked at, of texts
    # that may end in a brace, and bytes are cut, which needs no count of characters
    closed = reduce(or_, [s.endswith(e + n) for e in "}" + blanks for n in ("", "\n")])
    line = F.when(s.endswith("\n"), F.substring_index(s, "\n", -2)).otherwise(F.substring_index(s, "\n", -1))

    def first(v: Column, n: Column) -> Column:
        return F.substr(v.cast("binary"), F.lit(1), n).cast("string")

    def dropped(v: Column) -> Column:
        begin = F.octet_length(s) - F.octet_length(v)
        whole = F.ltrim(v, F.lit(blanks)).startswith("\\boxed{") & F.rtrim(v, F.lit(SPACES)).endswith("}")
        before = bound(first(s, begin - 1), lambda w: F.when(w.endswith("\r"), first(w, F.octet_length(w) - 1)).otherwise(w))
        behind_return = F.concat(first(s, begin), F.regexp_replace(v, r"\r[^\S\n]*\\boxed\{[^\n]*\}[^\S\n]*\n?\z", ""))
        return F.when(whole, before).when(v.contains("\r"), behind_return).otherwise(s)

    return F.when(closed, bound(line, dropped)).otherwise(s)


def vote_key(pred: str | Column, decimals: int = 6) -> Column:
    """Vote key of a prediction (rounded)."""
    return F.round(col_(pred), decimals)
