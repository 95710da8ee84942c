"""Language identification: a character n-gram naive-Bayes model.

The model is *fitted by a Spark job* on labelled text.  Scoring is a projection of the row: the log-probabilities
of a language are one dense array, a gram's index is arithmetic on its symbols, and numpy sums them over the Arrow batches
of a task (``functions.kernels``).  No gram becomes a row and no text is shuffled, however often a text repeats.

Size bound of the profile: grams are taken from text normalised to the
``letters`` class plus a space, so a profile holds at most
``(len(alphabet) + 1) ** n * len(languages)`` rows (30 symbols, n=3: 27,000 per
language) whatever the corpus size.  That bound is what makes the array a broadcast value.  Beyond ``DENSE_SIZE``
entries (long grams, large alphabets) grams are exploded and joined to the profile instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.answers import (DEFAULT_LETTERS, clean_eval, clean_letters, clean_reward, drop_final_boxed, letters_only,
                                 without_commands)
from ..functions.text import col_
from ..session import written

# Gates of the language signal.
MIN_CHARS = 15
THRESHOLD = 0.30

# Profile rows (gram x language) up to which the profile is broadcast.
BROADCAST_ROWS = 1_000_000
# Entries of a dense table of log-probabilities.
DENSE_SIZE = 300_000

LABEL_TARGET, LABEL_OTHER, LABEL_MIXED, LABEL_UNCLEAR = "target", "other", "mixed", "unclear"


def gram_text(text: str | Column, letters: str = DEFAULT_LETTERS) -> Column:
    """Normalise text for n-grams: lower case, every run of non-letters -> one space.
    Identity on the output of ``clean_eval``."""
    return letters_only(F.lower(F.coalesce(col_(text), F.lit(""))), letters)


def explode_grams(df: DataFrame, keys: Sequence[str], text: Column, n: int = 3,
                  letters: str = DEFAULT_LETTERS, keep_empty: bool = False) -> DataFrame:
    """One row per length-n substring of the normalised text: (keys..., gram).

    All overlapping grams come from one regex pass (a zero-width lookahead
    captures the n characters at every position), so the cost is linear in the
    text length; positional ``substring`` would rescan UTF-8 text per gram."""
    g = df.select(*keys, gram_text(text, letters).alias("_g"))
    every = F.regexp_extract_all("_g", F.lit(f"(?=(.{{{int(n)}}}))"), F.lit(1))
    gen = F.explode_outer(every) if keep_empty else F.explode(every)
    return g.select(*keys, gen.alias("gram"))


def fit_profile(df: DataFrame, text: str = "text", lang: str = "lang",
                languages: Sequence[str] = ("de", "en"), n: int = 3,
                letters: str = DEFAULT_LETTERS) -> DataFrame:
    """Add-one smoothed n-gram log-probabilities per language.

    Returns (gram, lang, logp) for every gram seen in any of ``languages``:
    logp = ln((count(lang, gram) + 1) / (total(lang) + |vocabulary|)).
    """
    langs = sorted(set(languages))
    rows = df.where(F.col(lang).isin(langs)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return written(profile_of_counts(gram_counts(rows, n, letters), langs), "profile")


def gram_counts(df: DataFrame, n: int = 3, letters: str = DEFAULT_LETTERS) -> DataFrame:
    """(lang, gram, c) of (text, lang) rows; tables of several inputs add up."""
    rows = df.select("lang", clean_eval("text", letters).alias("_c"))
    return explode_grams(rows, ["lang"], F.col("_c"), n, letters).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))


def profile_of_counts(counts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(gram, lang, logp) from the counts of all grams, one row for each (lang, gram)."""
    langs = sorted(set(languages))
    counts = written(counts, "profile-counts")
    # |vocabulary| and the per-language totals: len(langs) + 1 numbers read from
    # the small written count table.
    totals = {r["lang"]: r["total"] for r in
              counts.groupBy("lang").agg(F.sum("c").alias("total")).collect()}
    vsize = counts.select("gram").distinct().count()
    denom = F.lit(None).cast("double")
    for lg in langs:
        denom = F.when(F.col("lang") == lg, F.lit(float(totals.get(lg, 0) + vsize))).otherwise(denom)
    # Vocabulary x languages: a fan-out by the fixed language list, no cross join.
    vocab = counts.groupBy("gram").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by_lang"))
    return vocab.select("gram", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"),
                        "by_lang").select(
        "gram", "lang",
        F.log((F.coalesce(F.element_at("by_lang", F.col("lang")), F.lit(0)) + 1.0) / denom)
        .alias("logp"))


def language_scores(texts: DataFrame, key: str, text: str, profile: DataFrame,
                    languages: Sequence[str], n: int = 3,
                    letters: str = DEFAULT_LETTERS) -> DataFrame:
    """Per key: summed log-probability ``s_<lang>`` of its known grams (E2 core).

    Keys whose text has no known gram get 0 for every language."""
    langs = sorted(set(languages))
    # A text without grams keeps one row (null gram); unknown grams find no
    # profile row.  Every key therefore survives without a second pass.
    g = explode_grams(texts, [key], F.col(text), n, letters, keep_empty=True)
    # One profile row per gram with a column per language, so each gram of a
    # text meets one row (no fan-out by the number of languages).
    wide = profile.where(F.col("lang").isin(langs)).groupBy("gram").agg(
        *[F.max(F.when(F.col("lang") == lg, F.col("logp"))).alias(f"p_{lg}") for lg in langs])
    # Read from a written table, so the count is cheap; beyond the limit a plain join.
    side = F.broadcast(wide) if profile.count() <= BROADCAST_ROWS else wide
    j = g.join(side, "gram", "left")
    sums = j.groupBy(key).agg(*[F.sum(f"p_{lg}").alias(f"s_{lg}") for lg in langs])
    return sums.select(key, *[F.coalesce(F.col(f"s_{lg}"), F.lit(0.0)).alias(f"s_{lg}")
                              for lg in langs])


def with_confidences(scores: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Softmax of the summed log-probabilities: ``conf_<lang>`` sums to 1."""
    langs = sorted(set(languages))
    m = F.greatest(*[F.col(f"s_{lg}") for lg in langs]) if len(langs) > 1 else F.col(f"s_{langs[0]}")
    out = scores.withColumn("_m", m)
    for lg in langs:
        out = out.withColumn(f"_e_{lg}", F.exp(F.col(f"s_{lg}") - F.col("_m")))
    total = sum((F.col(f"_e_{lg}") for lg in langs), F.lit(0.0))
    out = out.withColumn("_z", total)
    for lg in langs:
        out = out.withColumn(f"conf_{lg}", F.col(f"_e_{lg}") / F.col("_z"))
    return out.drop("_m", "_z", *[f"_e_{lg}" for lg in langs])


def alphabet(letters: str) -> list[str] | None:
    """The symbols of normalised text: the lower-case characters of a class like ``A-Za-zæ`` and the space.
    None for a class with other syntax than characters and ranges."""
    chars = K.characters(letters)
    return None if chars is None else sorted({c for c in chars if c.lower() == c} | {" "})


@dataclass(frozen=True)
class DenseModel:
    """Log-probabilities by gram index, of one class of letters.  Symbol 0 is none of the alphabet's and has no grams."""

    letters: K.Letters
    n: int
    tables: dict[str, list[float]]

    def sums(self, text: Column, tables: dict[str, list[float]], trim: bool = True, bare: bool = False, final_line: bool = False) -> Column:
        """A struct of the length of the cleaned text and the sums of its grams' entries in ``tables``.

        ``bare``: of ``without_commands`` of the text, and with ``final_line`` of its ``signal_text``, taken in the same pass."""
        return K.gram_sums(text, self.letters, self.n, tables, trim, bare, final_line)


def dense_model(profile: DataFrame, languages: Sequence[str], n: int = 3, letters: str = DEFAULT_LETTERS) -> DenseModel | None:
    """The profile as dense tables; None where they would pass ``DENSE_SIZE`` entries.

    What comes to the driver is bounded by the alphabet, not by the corpus."""
    known = K.Letters.of(letters)
    if known is None or (len(known.symbols) + 1) ** n > DENSE_SIZE:
        return None
    symbols = known.symbols
    code = {c: at for at, c in enumerate(symbols, 1)}
    base = len(symbols) + 1
    tables = {lg: [0.0] * base ** n for lg in sorted(set(languages))}
    rows = profile.where(F.col("lang").isin(list(tables)) & (F.length("gram") == n)).select("lang", "gram", "logp")
    for lang, gram, logp in rows.toLocalIterator():
        if all(c in code for c in gram):
            at = 0
            for c in gram:
                at = at * base + code[c]
            tables[lang][at] = logp
    return DenseModel(known, n, tables)


def with_language_sums(df: DataFrame, text: Column, profile: DataFrame, languages: Sequence[str], n: int = 3,
                       letters: str = DEFAULT_LETTERS) -> DataFrame:
    """Adds ``s_<lang>``: the summed log-probability of the known grams of ``text`` (0 where there is none)."""
    langs = sorted(set(languages))
    model = dense_model(profile, langs, n, letters)
    if model is not None:
        sums = model.sums(K.lowered(F.coalesce(text, F.lit("")), model.letters), {f"s_{lg}": model.tables[lg] for lg in langs}, trim=False)
        return df.withColumn("_sums", sums).select(*df.columns, *[F.col(f"_sums.s_{lg}") for lg in langs])
    keyed = df.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_key", F.md5("_text"))
    sums = language_scores(keyed.select("_key", "_text").distinct(), "_key", "_text", profile, langs, n, letters)
    return keyed.drop("_text").join(sums, "_key").drop("_key")


def _differences(model: DenseModel, target: str, other: str) -> dict[str, list[float]]:
    """The softmax of two sums depends on their difference alone, so that one table of differences is summed."""
    return {"ahead": [t - o for t, o in zip(model.tables[target], model.tables[other])]}


def _pair(ahead: Column) -> list[Column]:
    one = F.lit(1.0)
    return [(one / (one + F.exp(-ahead))).alias("conf_target"), (one / (one + F.exp(ahead))).alias("conf_other")]


def with_pair_confidences(df: DataFrame, text: Column, profile: DataFrame, target: str, other: str, n: int = 3,
                          letters: str = DEFAULT_LETTERS) -> DataFrame:
    """Adds ``conf_target`` and ``conf_other``, null where ``text`` is null."""
    model = dense_model(profile, (target, other), n, letters)
    if model is not None:
        out = df.withColumn("_sums", model.sums(K.lowered(text, model.letters), _differences(model, target, other), trim=False))
        return out.select(*df.columns, *_pair(F.col("_sums.ahead")))
    out = with_confidences(with_language_sums(df.withColumn("_known", text.isNotNull()), text, profile, (target, other), n, letters), (target, other))
    return out.select(*df.columns, *[F.when(F.col("_known"), F.col(f"conf_{lg}")).alias(c) for lg, c in ((target, "conf_target"), (other, "conf_other"))])


def language_confidence(df: DataFrame, key: str, text: str, profile: DataFrame,
                        languages: Sequence[str] = ("de", "en"), n: int = 3,
                        letters: str = DEFAULT_LETTERS) -> DataFrame:
    """(key, conf_<lang>...) for each row of ``df``."""
    langs = sorted(set(languages))
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    if len(langs) == 2:
        out = with_pair_confidences(rows, F.col("_t"), profile, langs[0], langs[1], n, letters)
        return out.select(key, F.col("conf_target").alias(f"conf_{langs[0]}"), F.col("conf_other").alias(f"conf_{langs[1]}"))
    return with_confidences(with_language_sums(rows, F.col("_t"), profile, langs, n, letters), langs) \
        .select(key, *[f"conf_{lg}" for lg in langs])


def _best(sums: dict[str, Column]) -> Column:
    """The language of the largest sum; null for a tie and where no gram is known."""
    m = F.greatest(*sums.values()) if len(sums) > 1 else next(iter(sums.values()))
    best = F.filter(F.array(*[F.when(c == m, F.lit(lg)) for lg, c in sums.items()]), lambda x: x.isNotNull())
    # A text without known grams scores 0 in every language: a tie, unless there is one language only.
    return F.when((m < 0) & (F.size(best) == 1), F.element_at(best, 1))


def with_detected(df: DataFrame, texts: dict[str, str], profile: DataFrame, languages: Sequence[str], n: int = 3,
                  letters: str = DEFAULT_LETTERS) -> DataFrame:
    """E3 in the row: adds a column with the most likely language for each of ``texts`` (new column -> text column)."""
    langs = sorted(set(languages))
    model = dense_model(profile, langs, n, letters)
    out = df
    for name, text in texts.items():
        t = F.coalesce(F.col(text), F.lit(""))
        if model is not None:
            sums = out.withColumn("_sums", model.sums(t, {f"s_{lg}": model.tables[lg] for lg in langs}, bare=True))
            found = _best({lg: F.col(f"_sums.s_{lg}") for lg in langs})
        else:
            sums = with_language_sums(out, clean_letters(without_commands(t), letters), profile, langs, n, letters)
            found = _best({lg: F.col(f"s_{lg}") for lg in langs})
        out = sums.select(*out.columns, found.alias(name))
    return out


def is_target(detected: Column, text: Column, target: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\S") & F.coalesce(detected == target, F.lit(False))


def detect_language(df: DataFrame, key: str, text: str, profile: DataFrame,
                    languages: Sequence[str], target: str | None = None,
                    n: int = 3, letters: str = DEFAULT_LETTERS) -> DataFrame:
    """Most likely language, and ``is_target``.  A text without a known gram, or
    whose best two languages tie, has no language (null) and is never the target."""
    out = with_detected(df.select(key, F.col(text).alias("_t")), {"detected": "_t"}, profile, languages, n, letters)
    if target is None:
        return out.select(key, "detected")
    return out.select(key, "detected", is_target(F.col("detected"), F.col("_t"), target).alias("is_target"))


def signal_columns(conf_t: Column, conf_o: Column, cleaned_len: Column,
                   min_chars: int = MIN_CHARS, threshold: float = THRESHOLD) -> dict[str, Column]:
    """E4 gates: under ``min_chars`` cleaned chars -> unclear with score 0."""
    short = cleaned_len < min_chars
    score = F.when(short, F.lit(0.0)).otherwise(conf_t - conf_o)
    label = (F.when(short, F.lit(LABEL_UNCLEAR))
             .when(score >= threshold, F.lit(LABEL_TARGET))
             .when(score <= -threshold, F.lit(LABEL_OTHER))
             .otherwise(F.lit(LABEL_MIXED)))
    return {"lang_score": score, "lang_label": label}


def signal_text(text: Column, exclude_final_line: bool = True) -> Column:
    """The text that the language signal of a completion is taken from; ``clean_letters`` of it is scored."""
    return without_commands(drop_final_boxed(text) if exclude_final_line else F.coalesce(text, F.lit("")))


def with_signal(df: DataFrame, text: Column, profile: DataFrame, target: str, other: str,
                min_chars: int = MIN_CHARS, threshold: float = THRESHOLD, n: int = 3,
                letters: str = DEFAULT_LETTERS, exclude_final_line: bool = True) -> DataFrame:
    """Adds cleaned_len, conf_target, conf_other, lang_score and lang_label of the ``signal_text`` of a text;
    all are null where it is null.  Texts of under ``min_chars`` letters are unclear."""
    length = F.col("cleaned_len")
    model = dense_model(profile, (target, other), n, letters)
    if model is not None:
        base = df.withColumn("_sums", model.sums(text, _differences(model, target, other), bare=True, final_line=exclude_final_line))
        scored = base.select(*df.columns, F.col("_sums.length").alias("cleaned_len"), *_pair(F.col("_sums.ahead")))
    else:
        cleaned = clean_letters(signal_text(text, exclude_final_line), letters)
        base = df.withColumn("_cleaned", F.when(text.isNotNull(), cleaned)).withColumn("cleaned_len", F.length("_cleaned"))
        scored = with_pair_confidences(base, F.when(length >= min_chars, F.col("_cleaned")), profile, target, other, n, letters).drop("_cleaned")
    for c in ("conf_target", "conf_other"):
        scored = scored.withColumn(c, F.when(length < min_chars, F.lit(0.0)).otherwise(F.col(c)))
    cols = signal_columns(F.col("conf_target"), F.col("conf_other"), length, min_chars, threshold)
    return scored.select("*", *[F.when(length.isNotNull(), v).alias(k) for k, v in cols.items()])


def language_signal(df: DataFrame, text: str, profile: DataFrame, target: str, other: str,
                    min_chars: int = MIN_CHARS, threshold: float = THRESHOLD,
                    exclude_final_line: bool = True, letters: str = DEFAULT_LETTERS) -> DataFrame:
    """E4 on any table: adds cleaned_len, conf_target, conf_other, lang_score,
    lang_label.  A projection: texts stay in their rows."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return with_signal(df, whole, profile, target, other, min_chars, threshold, letters=letters, exclude_final_line=exclude_final_line)


def language_reward(df: DataFrame, text: str, profile: DataFrame, target: str, other: str,
                    weight: float = 1.0, exclude_final_line: bool = True,
                    min_chars: int = MIN_CHARS, letters: str = DEFAULT_LETTERS) -> DataFrame:
    """E5: adds ``language_reward`` = weight * (conf_target - conf_other); 0.0 when the
    reward-cleaned text is shorter than ``min_chars``.  A projection, as E4."""
    t = F.coalesce(F.col(text), F.lit(""))
    cleaned = clean_reward(drop_final_boxed(t) if exclude_final_line else t)
    base = df.withColumn("_cleaned", cleaned)
    scored = with_pair_confidences(base, F.when(F.length("_cleaned") >= min_chars, F.col("_cleaned")), profile, target, other, letters=letters)
    reward = F.coalesce(F.lit(weight) * (F.col("conf_target") - F.col("conf_other")), F.lit(0.0))
    return scored.select(*df.columns, reward.alias("language_reward"))
