"""Prompt rendering and training-set building.

Prompt texts are fixed values: each (family, mode, reasoning) has its own
template, never merged, because the wording differs in small words between
families.  Rendering is a ``concat`` of literals and columns (a null question
renders as '').
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import boxed_answer, boxed_answer_en, gold_number, gold_text
from ..functions.text import nonblank, strip
from .splits import order_key

# ---------------------------------------------------------------------------
# System and user prompt texts.
# Placeholders: {question} = the question in the mode's language,
# {da_question} / {en_question} = both questions (mode da_en).
# ---------------------------------------------------------------------------
SYSTEM_DA = "Du er en hjælpsom assistent, der løser matematikopgaver."
SYSTEM_EN = "You are a helpful assistant that solves math problems."

EVAL_EN = ("Solve the problem step by step in English.\n"
           "End with a final line EXACTLY in the format:\n"
           "\\boxed{<number>}\n\n"
           "Question: {question}\nAnswer:\n")
EVAL_DA = ("Løs opgaven trin for trin på dansk.\n"
           "Afslut altid med en sidste linje præcis på formatet:\n"
           "\\boxed{<tal>}\n\n"
           "Spørgsmål: {question}\nSvar:\n")
EVAL_DA_EN = ("Du får både en dansk opgave du skal løse, samt en engelsk referenceoversættelse.\n"
              "Brug kun den engelske tekst til at afklare betydningen af problemet.\n"
              "Løs opgaven trin for trin på dansk.\n"
              "Afslut altid med en sidste linje præcis på formatet:\n"
              "\\boxed{<tal>}\n"
              "Skriv kun tallet i boksen (ingen tekst, ingen enheder, ingen ekstra linjer).\n\n"
              "DA: {da_question}\n\n"
              "EN: {en_question}\n\n"
              "Svar:\n")
SFT_DA_REASON = ("Løs opgaven trin for trin.\n"
                 "Afslut altid med en sidste linje præcis på formatet:\n"
                 "\\boxed{<tal>}\n"
                 "Skriv kun tallet i boksen (ingen tekst, ingen enheder).\n\n"
                 "Spørgsmål: {question}\n"
                 "Svar:\n")
SFT_DA_SHORT = ("Returner kun den endelige løsning på én linje præcis på formatet:\n"
                "\\boxed{<tal>}\n"
                "Skriv kun tallet i boksen (ingen tekst, ingen enheder).\n\n"
                "Spørgsmål: {question}\n"
                "Svar:\n")
SFT_EN_REASON = ("Solve the problem step by step.\n"
                 "Always end with a final line EXACTLY in the format:\n"
                 "\\boxed{<number>}\n"
                 "Write only the number in the box (no text, no units).\n\n"
                 "Question: {question}\n"
                 "Answer:\n")
SFT_EN_SHORT = ("Return only the final answer on one line EXACTLY in the format:\n"
                "\\boxed{<number>}\n"
                "Write only the number in the box (no text, no units).\n\n"
                "Question: {question}\n"
                "Answer:\n")
DA_ONLY_REASON = ("Løs opgaven trin for trin på dansk.\n"
                  "Afslut altid med en sidste linje præcis i formatet:\n"
                  "\\boxed{<tal>}\n"
                  "Skriv kun tallet i boksen (ingen tekst, ingen enheder).\n\n"
                  "Spørgsmål: {question}\n"
                  "Svar:\n")
DA_ONLY_SHORT = SFT_DA_SHORT
RL_DA_REASON = EVAL_DA
RL_DA_SHORT = ("{question}\n\n"
               "Returnér KUN det endelige svar på én linje PRÆCIS i dette format:\n"
               "\\boxed{<tal>}")
RL_DA_EN_REASON = EVAL_DA_EN
RL_DA_EN_SHORT = ("Du får både en dansk opgave og en engelsk referenceoversættelse.\n"
                  "Brug kun den engelske tekst til at afklare betydningen af problemet.\n\n"
                  "DA: {da_question}\n\n"
                  "EN: {en_question}\n\n"
                  "Returnér KUN det endelige svar på én linje PRÆCIS i dette format:\n"
                  "\\boxed{<tal>}")
EN_ONLY = ("Solve the question step by step.\n"
           "End your response with a final line EXACTLY in this format:\n"
           "\\boxed{<number>}\n"
           "Write only the number inside the box (no text, no units, no extra lines).\n\n"
           "Question: {question}\n"
           "Answer:")

REVIEW_SYSTEM = (
    "You are a strict bilingual math QA reviewer.\n"
    "You will receive English and Danish versions of a math word problem (question + answer for each).\n"
    "Evaluate with these dimensions:\n"
    " 1) en_ok: English reasoning and final numeric result are correct for the EN question.\n"
    " 2) da_ok: Danish reasoning and final numeric result are correct for the DA question.\n"
    " 3) math_ok_en / math_ok_da: math is sound step-by-step in EN/DA answers.\n"
    " 4) crosslang_ok: EN and DA describe the same scenario (names, units, quantities, semantics) "
    "and yield the same final numeric result.\n"
    " 5) name_mismatch: True if proper names differ across EN/DA or Q/A (e.g., Natalia vs Julia). "
    "If true, do not suggest edits.\n"
    " 6) issues: short structured list of specific problems (target: EN|DA|CROSSLANG|MATH, type, "
    "brief, optional fix_suggestion).\n"
    " 7) severity: none|minor|moderate|major|critical (reflects impact on correctness/clarity).\n"
    "Give a concise summary in 'comment' (1–2 sentences). If everything is fine, severity='none' "
    "and verdict='OK'.\n"
    "Return STRICT JSON ONLY (no Markdown), exactly this schema:\n"
    "{\n"
    '  "en_ok": true/false,\n'
    '  "da_ok": true/false,\n'
    '  "math_ok_en": true/false,\n'
    '  "math_ok_da": true/false,\n'
    '  "crosslang_ok": true/false,\n'
    '  "name_mismatch": true/false,\n'
    '  "issues": [\n'
    '    {"target":"EN|DA|CROSSLANG|MATH", "type":"short", "brief":"short", '
    '"fix_suggestion":"optional or empty"}\n'
    '  ],\n'
    '  "severity": "none|minor|moderate|major|critical",\n'
    '  "comment": "short",\n'
    '  "verdict": "OK|ISSUE"\n'
    "}\n"
)
REVIEW_USER = ("Evaluate this bilingual math item.\n\n"
               "English Question:\n{question}\n\n"
               "English Answer:\n{answer}\n\n"
               "Danish Question:\n{da_question}\n\n"
               "Danish Answer:\n{da_answer}\n")
TRANSLATE_USER = (
    "\n"
    "    You are a world-class English→Danish translator specialized in math word problems.\n"
    "    Translate both the question and the answer below into Danish in a consistent way:\n"
    "    - Keep all math notation, numbers, and reasoning structure identical.\n"
    "    - Use natural, standard Danish phrasing.\n"
    "    - Do NOT add explanations or comments.\n"
    "    - Output clearly labeled text sections as:\n"
    "\n"
    "    Danish Question:\n"
    "    [your translation of the question]\n"
    "\n"
    "    Danish Answer:\n"
    "    [your translation of the answer]\n"
    "\n"
    "    English Question:\n"
    "    {question}\n"
    "\n"
    "    English Answer:\n"
    "    {answer}\n"
    "    ")

# (family, mode, reasoning) -> (system prompt or None, user template)
TEMPLATES: dict[tuple[str, str, bool], tuple[str | None, str]] = {
    ("eval", "en", True): (SYSTEM_EN, EVAL_EN),
    ("eval", "en", False): (SYSTEM_EN, EVAL_EN),
    ("eval", "da", True): (SYSTEM_DA, EVAL_DA),
    ("eval", "da", False): (SYSTEM_DA, EVAL_DA),
    ("eval", "da_en", True): (SYSTEM_DA, EVAL_DA_EN),
    ("eval", "da_en", False): (SYSTEM_DA, EVAL_DA_EN),
    ("sft_paired", "da", True): (SYSTEM_DA, SFT_DA_REASON),
    ("sft_paired", "da", False): (SYSTEM_DA, SFT_DA_SHORT),
    ("sft_paired", "en", True): (SYSTEM_EN, SFT_EN_REASON),
    ("sft_paired", "en", False): (SYSTEM_EN, SFT_EN_SHORT),
    ("sft_unpaired", "da", True): (SYSTEM_DA, SFT_DA_REASON),
    ("sft_unpaired", "da", False): (SYSTEM_DA, SFT_DA_SHORT),
    ("sft_unpaired", "en", True): (SYSTEM_EN, SFT_EN_REASON),
    ("sft_unpaired", "en", False): (SYSTEM_EN, SFT_EN_SHORT),
    ("sft_da", "da", True): (SYSTEM_DA, DA_ONLY_REASON),
    ("sft_da", "da", False): (SYSTEM_DA, DA_ONLY_SHORT),
    ("rl", "da", True): (None, RL_DA_REASON),
    ("rl", "da", False): (None, RL_DA_SHORT),
    ("rl", "da_en", True): (None, RL_DA_EN_REASON),
    ("rl", "da_en", False): (None, RL_DA_EN_SHORT),
    ("rl_da", "da", True): (None, RL_DA_REASON),
    ("rl_da", "da", False): (None, RL_DA_SHORT),
    ("sft_en", "en", True): (None, EN_ONLY),
}

_PLACEHOLDER = re.compile(r"\{(question|da_question|en_question|answer|da_answer)\}")


def question_columns(mode: str) -> dict[str, Column]:
    """Item columns behind the placeholders for a prompt mode."""
    q = F.col("question") if mode == "en" else F.col("da_question")
    return {"question": q, "da_question": F.col("da_question"), "en_question": F.col("question"),
            "answer": F.col("answer"), "da_answer": F.col("da_answer")}


def fill(template: str, values: dict[str, Column]) -> Column:
    """``concat`` of the template's literal parts and the placeholder columns."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)], F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def template(family: str, mode: str, reasoning: bool = True) -> tuple[str | None, str]:
    try:
        return TEMPLATES[(family, mode, reasoning)]
    except KeyError:
        raise ValueError(f"Unknown prompt: family={family!r} mode={mode!r} "
                         f"reasoning={reasoning!r}") from None


def render_prompts(df: DataFrame, family: str, mode: str, reasoning: bool = True) -> DataFrame:
    """Adds ``system`` (null when the family has none) and ``user``."""
    system, user = template(family, mode, reasoning)
    return df.withColumn("system", F.lit(system).cast("string")) \
        .withColumn("user", fill(user, question_columns(mode)))


def render_all(df: DataFrame, keys: Sequence[tuple[str, str, bool]] | None = None) -> DataFrame:
    """D1 for many templates at once: one output row per (item, template); the
    fan-out is the fixed template list, the text is filled per row."""
    keys = list(keys or TEMPLATES)
    ids = F.explode(F.array(*[F.lit(i) for i in range(len(keys))])).alias("_t")
    x = df.select("*", ids)
    def pick(values):
        out = None
        for i, v in enumerate(values):
            out = (F.when(F.col("_t") == i, v) if out is None else out.when(F.col("_t") == i, v))
        return out
    fam = pick([F.lit(k[0]) for k in keys])
    mode = pick([F.lit(k[1]) for k in keys])
    reas = pick([F.lit(k[2]) for k in keys])
    system = pick([F.lit(TEMPLATES[k][0]).cast("string") for k in keys])
    user = pick([fill(TEMPLATES[k][1], question_columns(k[1])) for k in keys])
    return x.select(*df.columns, fam.alias("family"), mode.alias("mode"),
                    reas.alias("reasoning"), system.alias("system"), user.alias("user"))


def messages(system: Column | None, user: Column, assistant: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>> of the chat turns."""
    turns = []
    if system is not None:
        turns.append(F.struct(F.lit("system").alias("role"), system.alias("content")))
    turns.append(F.struct(F.lit("user").alias("role"), user.alias("content")))
    if assistant is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return F.array(*turns)


def to_messages(df: DataFrame, family: str, mode: str, reasoning: bool = True,
                assistant: Column | None = None) -> DataFrame:
    """Adds ``messages`` for one prompt mode; unknown modes are an error."""
    system, user = template(family, mode, reasoning)
    sys_col = F.lit(system) if system is not None else None
    return df.withColumn("messages", messages(sys_col, fill(user, question_columns(mode)), assistant))


# Default chat layout (ChatML, used by the evaluated model family).
CHATML = {"prefix": "<|im_start|>{role}\n", "suffix": "<|im_end|>\n",
          "generation_prompt": "<|im_start|>assistant\n"}


def render_messages(column: str | Column, layout: dict[str, str] = CHATML,
                    add_generation_prompt: bool = False) -> Column:
    """D3 for a message array (D2): the chat text, a projection of the row.  A null
    array renders as null, a null content or role as ''."""
    def turn(m):
        parts = layout["prefix"].split("{role}")
        named = [x for i, part in enumerate(parts)
                 for x in ([F.lit(part)] + ([F.coalesce(m["role"], F.lit(""))] if i < len(parts) - 1 else []))]
        return F.concat(*named, F.coalesce(m["content"], F.lit("")), F.lit(layout["suffix"]))
    col = F.col(column) if isinstance(column, str) else column
    text = F.array_join(F.transform(col, turn), "")
    return F.concat(text, F.lit(layout["generation_prompt"])) if add_generation_prompt else text


def render_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", layout: dict[str, str] = CHATML,
                 add_generation_prompt: bool = False, chunk: int = 256) -> DataFrame:
    """D3: one text per conversation, turns in order.

    Each turn is rendered where it lies.  The pieces are joined in two levels:
    first within chunks of at most ``chunk`` consecutive turns (bounded groups,
    spread over tasks even for a very long conversation), then the chunk texts
    of a conversation in order.  Only rendered strings are grouped."""
    pre_parts = layout["prefix"].split("{role}")
    prefix = F.concat(*[p for i, part in enumerate(pre_parts)
                        for p in ([F.lit(part)] + ([F.col(role)] if i < len(pre_parts) - 1 else []))])
    piece = F.concat(prefix, F.coalesce(F.col(text), F.lit("")), F.lit(layout["suffix"]))
    rendered = turns.select(key, F.floor(F.col(turn) / chunk).alias("_chunk"),
                            F.struct(F.col(turn).alias("t"), piece.alias("p")).alias("x"))

    def ordered_join(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["p"]), "")

    chunks = rendered.groupBy(key, "_chunk").agg(ordered_join("x").alias("_p"))
    chats = chunks.groupBy(key).agg(
        ordered_join(F.struct(F.col("_chunk").alias("t"), F.col("_p").alias("p"))).alias("chat"))
    if add_generation_prompt:
        chats = chats.withColumn("chat", F.concat("chat", F.lit(layout["generation_prompt"])))
    return chats


def expand_paired(items: DataFrame, seed: int = 42) -> DataFrame:
    """Every item gives a target-language row then a source-language row
    (pos 0, 1); nulls are kept (a null answer becomes \\boxed{})."""
    pair = F.array(
        F.struct(F.lit("da").alias("lang"), F.col("da_question").alias("q"),
                 boxed_answer("da_answer").alias("a")),
        F.struct(F.lit("en").alias("lang"), F.col("question").alias("q"),
                 boxed_answer("answer").alias("a")))
    return items.select("pid", order_key(F.col("pid"), seed).alias("order_key"),
                        F.posexplode(pair).alias("pos", "x")) \
        .select("pid", "order_key", "pos", "x.lang", "x.q", "x.a")


def expand_unpaired(items: DataFrame, seed: int = 42) -> DataFrame:
    """Per language, drop null/blank question or answer, strip, order by the
    language's own seed (target seed+999, source seed); union; final order by
    seed+123."""
    def side(lang, q, a, s):
        return items.where(nonblank(q) & nonblank(a)).select(
            "pid", F.lit(lang).alias("lang"), strip(q).alias("q"),
            boxed_answer(strip(F.col(a))).alias("a"),
            order_key(F.col("pid"), s).alias("lang_order_key"))
    both = side("da", "da_question", "da_answer", seed + 999) \
        .unionByName(side("en", "question", "answer", seed))
    return both.withColumn("order_key", order_key(F.concat_ws(":", F.col("pid").cast("string"),
                                                              F.col("lang")), seed + 123))


def expand_single(items: DataFrame, seed: int = 42) -> DataFrame:
    """Target-language rows only (no null filter)."""
    return items.select("pid", order_key(F.col("pid"), seed).alias("order_key"),
                        F.col("da_question").alias("q"), boxed_answer("da_answer").alias("a"))


def to_rl_set(items: DataFrame, mode: str = "da_en", reasoning: bool = True,
              family: str = "rl") -> DataFrame:
    """One user-turn prompt and ``solution = \\boxed{gold text}``."""
    if mode not in ("da", "da_en"):
        raise ValueError(f"Unknown PROMPT_MODE: {mode}")
    _, user = template(family, mode, reasoning)
    return items.select("pid", F.lit(mode).alias("mode"),
                        fill(user, question_columns(mode)).alias("prompt"),
                        F.concat(F.lit("\\boxed{"), gold_text("da_answer"), F.lit("}")).alias("solution"))


def to_messages_en(items: DataFrame) -> DataFrame:
    """User + assistant turns, no system turn; rejected answers (two '####'
    markers) are left out."""
    response, rejected = boxed_answer_en(F.col("answer"))
    _, user = template("sft_en", "en", True)
    return items.where(~rejected).select(
        "pid", messages(None, fill(user, question_columns("en")), response).alias("messages"))


def review_requests(items: DataFrame) -> DataFrame:
    """System text + the four-part user text (a null part, or one whose column is
    missing, renders as '')."""
    cols = {k: F.col(k) if k in items.columns else F.lit("")
            for k in ("question", "answer", "da_question", "da_answer")}
    return items.select("pid", F.lit(REVIEW_SYSTEM).alias("system"),
                        fill(REVIEW_USER, cols).alias("user"))


def translation_requests(items: DataFrame, id_col: str = "pid") -> DataFrame:
    """One translation prompt per item holding its question and answer."""
    cols = {"question": F.col("question"), "answer": F.col("answer")}
    return items.select(F.col(id_col).alias("id"), fill(TRANSLATE_USER, cols).alias("prompt"))


def prepare_modes(items: DataFrame, modes: Sequence[str] = ("en", "da", "da_en"),
                  reasoning: bool = True) -> DataFrame:
    """Per item and mode: system and user prompt and the gold number
    (source answer for 'en', target answer otherwise)."""
    for m in modes:
        template("eval", m, reasoning)
    x = items.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    system = user = None
    for m in modes:
        s, u = template("eval", m, reasoning)
        cond = F.col("mode") == m
        system = F.when(cond, F.lit(s)) if system is None else system.when(cond, F.lit(s))
        u_col = fill(u, question_columns(m))
        user = F.when(cond, u_col) if user is None else user.when(cond, u_col)
    gold = F.when(F.col("mode") == "en", gold_number("answer")).otherwise(gold_number("da_answer"))
    return x.select("pid", "mode", system.alias("system"), user.alias("user"), gold.alias("gold"))
