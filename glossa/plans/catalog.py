"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through ``glossa.sources.fixtures``) over
their whole extent.  Doubles are rounded to 6 places and integer columns cast
to BIGINT so the result compares value-for-value with the SQL statement of the
same result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import language as L
from ..operators import metrics as M
from ..operators import scaling as G
from ..operators import scoring as S
from ..operators.profiles import ProfileStore
from ..session import checkpoint_root
from ..sources import fixtures as X

# Test tables hold de/en/fr/es prose and no Danish: the target language of the
# language model is German, the other one English (both are parameters).
TARGET, OTHER = "de", "en"
DETECT_LANGS = ("de", "en", "es", "fr")
NS = tuple(range(1, 11))

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def profile(spark: SparkSession, sf: str, languages=(TARGET, OTHER)) -> DataFrame:
    """The language model of a corpus, kept below the shared folder: refitted when the corpus changes
    (only new files are counted), read otherwise."""
    path = f"{sf.rstrip('/')}/documents.parquet"
    root = f"{checkpoint_root(spark).rstrip('/')}/glossa-profiles/{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    store = ProfileStore(spark, root, lambda files: X.spread(spark.read.parquet(*files).select("text", "lang")))
    return store.refresh(path, languages)


def scored(spark: SparkSession, sf: str, target_modes=S.TARGET_MODES_SCALING) -> DataFrame:
    return S.score_completions(X.completions(spark, sf), X.items(spark, sf),
                               profile(spark, sf), TARGET, OTHER, target_modes)


# ---- C: answer extraction ----------------------------------------------------

@query("c1_gold_number")
def c1(spark, sf):
    it = X.items(spark, sf)
    return it.select("pid", A.gold_number("answer").alias("gold_en"),
                     A.gold_number("da_answer").alias("gold_da"))


@query("c3_boxed_number")
def c3(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.boxed_number("text").alias("pred"))


@query("c4_boxed_flag")
def c4(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.boxed_flag("text").alias("boxed"))


# ---- F: scoring --------------------------------------------------------------

@query("f1_attach_gold")
def f1(spark, sf):
    return S.attach_gold(X.completions(spark, sf), X.items(spark, sf)).select(*S.KEY, "gold")


@query("g1_accuracy_boxed")
def g1(spark, sf):
    # no language is read, so that none is computed (a projection that goes)
    m = M.eval_metrics(scored(spark, sf, S.TARGET_MODES_EVAL), X.items(spark, sf))
    return m.select("model", "mode", r6("accuracy").alias("accuracy"),
                    r6("boxed_rate").alias("boxed_rate"))


@query("c2_gold_text")
def c2(spark, sf):
    it = X.items(spark, sf)
    return it.select("pid", A.gold_text("answer").alias("gold_text_en"),
                     A.gold_text("da_answer").alias("gold_text_da"))


@query("c5_boxed_answer")
def c5(spark, sf):
    it = X.items(spark, sf)
    return it.select("pid", A.boxed_answer("answer").alias("boxed_answer_en"),
                     A.boxed_answer("da_answer").alias("boxed_answer_da"))


@query("c6_boxed_answer_en")
def c6(spark, sf):
    it = X.items(spark, sf)
    resp, rej = A.boxed_answer_en(F.col("answer"))
    return it.select("pid", resp.alias("response"), rej.alias("rejected"))


@query("c7_clean_eval")
def c7(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.clean_eval("text").alias("cleaned"))


@query("c8_clean_reward")
def c8(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.clean_reward("text").alias("cleaned"))


@query("c9_drop_final_boxed")
def c9(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.drop_final_boxed("text").alias("content"))


@query("c10_vote_key")
def c10(spark, sf):
    c = X.completions(spark, sf)
    return c.select(*S.KEY, A.vote_key(A.boxed_number("text")).alias("vote_key"))


# ---- E: language model -------------------------------------------------------

@query("e1_fit_profile")
def e1(spark, sf):
    return profile(spark, sf).select("lang", "gram", r6("logp").alias("logp"))


@query("e2_language_confidence")
def e2(spark, sf):
    d = X.labelled_text(spark, sf)
    conf = L.language_confidence(d.select("doc_id", A.clean_eval("text").alias("t")),
                                 "doc_id", "t", profile(spark, sf), (TARGET, OTHER))
    return conf.select("doc_id", r6(f"conf_{TARGET}").alias("conf_target"),
                       r6(f"conf_{OTHER}").alias("conf_other"))


@query("e3_detect_language")
def e3(spark, sf):
    d = X.labelled_text(spark, sf)
    prof = profile(spark, sf, DETECT_LANGS)
    return L.detect_language(d, "doc_id", "text", prof, DETECT_LANGS, TARGET) \
        .select("doc_id", "detected", "is_target")


@query("e4_language_signal")
def e4(spark, sf):
    c = X.completions(spark, sf)
    sig = L.language_signal(c, "text", profile(spark, sf), TARGET, OTHER)
    return sig.select(*S.KEY, "cleaned_len", "lang_label", r6("lang_score").alias("lang_score"))


@query("e5_language_reward")
def e5(spark, sf):
    c = X.completions(spark, sf)
    r = L.language_reward(c, "text", profile(spark, sf), TARGET, OTHER)
    return r.select(*S.KEY, r6("language_reward").alias("language_reward"))


# ---- F: scoring --------------------------------------------------------------

def _scored_out(df):
    return df.select(*S.KEY, "gold", "boxed", "pred", "correct", "lang_label",
                     r6("lang_score").alias("lang_score"))


@query("f2_score_completions")
def f2(spark, sf):
    return _scored_out(scored(spark, sf))


@query("f3_accuracy_reward")
def f3(spark, sf):
    rows = S.accuracy_reward(X.completions(spark, sf), solutions=S.rl_solutions(X.items(spark, sf)))
    return rows.select(*S.KEY, "accuracy_reward")


@query("f4_total_reward")
def f4(spark, sf):
    rewards = S.default_rewards(profile(spark, sf), TARGET, OTHER, solutions=S.rl_solutions(X.items(spark, sf)))
    out = S.total_reward(X.completions(spark, sf), rewards)
    return out.select(*S.KEY, "accuracy_reward", r6("language_reward").alias("language_reward"),
                      r6("total_reward").alias("total_reward"))


# ---- G: aggregation ----------------------------------------------------------

@query("g2_language_rates")
def g2(spark, sf):
    m = M.eval_metrics(scored(spark, sf, S.TARGET_MODES_EVAL), X.items(spark, sf))
    return m.select("model", "mode", *[r6(k).alias(k) for k in
                                       ["target_rate", "other_rate", "mixed_rate", "unclear_rate"]])


@query("g3_strict_accuracy")
def g3(spark, sf):
    m = M.eval_metrics(scored(spark, sf, S.TARGET_MODES_EVAL), X.items(spark, sf))
    return m.select("model", "mode", r6("strict_accuracy").alias("strict_accuracy"),
                    r6("correct_but_not_target_rate").alias("correct_but_not_target_rate"))


@query("g4_mean_contrast")
def g4(spark, sf):
    m = M.eval_metrics(scored(spark, sf, S.TARGET_MODES_EVAL), X.items(spark, sf))
    return m.select("model", "mode", r6("avg_target_minus_other").alias("avg_target_minus_other"))


@query("g5_length_summary")
def g5(spark, sf):
    s = M.length_summary(X.completions(spark, sf))
    return s.select("model", "mode", r6("avg_words").alias("avg_words"), "max_words",
                    r6("p50_words").alias("p50_words"))


def _samples(spark, sf):
    """Scored rows written once (lineage cut in the shared checkpoint folder);
    the best-of-N, majority and mix jobs all read this table instead of
    re-running the scoring in each of their branches.  Samples beyond the largest
    prefix are left out before anything is read from their texts."""
    return L.written(scored(spark, sf).where(F.col("sample_idx") < max(NS)), "scored")


def _round_all(df, keys):
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


@query("g6_best_of_n")
def g6(spark, sf):
    b = G.best_of_n(_samples(spark, sf), X.items(spark, sf), NS)
    return _round_all(b.select("model", "mode", F.col("n").cast("long").alias("n"),
                               *G.BEST_BASE), ["model", "mode", "n"])


@query("g7_best_of_n_target")
def g7(spark, sf):
    b = G.best_of_n(_samples(spark, sf), X.items(spark, sf), NS)
    return _round_all(b.select("model", "mode", F.col("n").cast("long").alias("n"),
                               *G.BEST_TARGET), ["model", "mode", "n"])


@query("g8_majority_winner")
def g8(spark, sf):
    return _winner_columns(G.majority_winner(G.voters(_samples(spark, sf), max(NS)), NS))


def _winner_columns(w):
    return w.select("pid", "model", "mode", F.col("n").cast("long").alias("n"), "pred",
                    F.col("votes").cast("long").alias("votes"), "winner_idx", "correct", "boxed",
                    "lang_label", r6("lang_score").alias("lang_score"))


def _majority(spark, sf):
    s = _samples(spark, sf)
    return G.majority_metrics(G.majority_winner(G.voters(s, max(NS)), NS), s, X.items(spark, sf), NS)


@query("g9_majority_metrics")
def g9(spark, sf):
    m = _majority(spark, sf)
    return _round_all(m.select("model", "mode", F.col("n").cast("long").alias("n"),
                               *G.MAJ_BASE, *G.MAJ_TARGET[:-1]), ["model", "mode", "n"])


@query("g10_majority_contrast")
def g10(spark, sf):
    m = _majority(spark, sf)
    return m.select("model", "mode", F.col("n").cast("long").alias("n"),
                    r6("selected_avg_target_minus_other").alias("selected_avg_target_minus_other"))


@query("g11_sample_language_mix")
def g11(spark, sf):
    m = G.sample_language_mix(_samples(spark, sf), X.items(spark, sf), NS)
    return _round_all(m.withColumn("n", F.col("n").cast("long")), ["model", "mode", "n"])


@query("g12_pivot_metrics")
def g12(spark, sf):
    w = M.eval_wide(scored(spark, sf, S.TARGET_MODES_EVAL), X.items(spark, sf), ("da", "en"))
    return _round_all(w, ["model"])


def scaling_long(spark, sf):
    s = _samples(spark, sf)
    items = X.items(spark, sf)
    best = G.best_of_n(s, items, NS)
    mix = G.sample_language_mix(s, items, NS)
    maj = G.majority_metrics(G.majority_winner(G.voters(s, max(NS)), NS), s, items, NS)
    return G.scaling_long(best, mix, maj)


@query("g13_scaling_series")
def g13(spark, sf):
    ser = M.scaling_series(scaling_long(spark, sf), ("en", "da"), "da", NS)
    return ser.select("model", "safe_model", "figure", "series", "n", r6("percent").alias("percent"))


# ---- D: dataset building -----------------------------------------------------
from ..operators import prompts as D  # noqa: E402
from ..operators import review as H  # noqa: E402
from ..operators import splits as B  # noqa: E402

SEED = 42


@query("d1_render_prompts")
def d1(spark, sf):
    r = D.render_all(X.items(spark, sf).select("pid", "question", "da_question", "answer", "da_answer"))
    return r.select("pid", "family", "mode", "reasoning", "system", "user")


@query("d2_to_messages")
def d2(spark, sf):
    it = X.items(spark, sf)
    out = None
    for mode in ("en", "da", "da_en"):
        m = D.to_messages(it, "eval", mode).select("pid", F.lit(mode).alias("mode"),
                                                   F.posexplode("messages").alias("msg_idx", "m"))
        out = m if out is None else out.unionByName(m)
    return out.select("pid", "mode", F.col("msg_idx").cast("long").alias("msg_idx"),
                      F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query("d3_render_chats")
def d3(spark, sf):
    conv = X.table(spark, sf, "conversations")
    # the prompt text is the rendered chat and the generation prompt: one pass
    return D.render_chats(conv).select("conv_id", F.col("chat").alias("chat_train"), F.concat(
        "chat", F.lit(D.CHATML["generation_prompt"])).alias("chat_prompt"))


@query("d4_expand_paired")
def d4(spark, sf):
    return D.expand_paired(X.items(spark, sf), SEED).select(
        "pid", "order_key", F.col("pos").cast("long").alias("pos"), "lang", "q", "a")


@query("d5_expand_unpaired")
def d5(spark, sf):
    return D.expand_unpaired(X.items(spark, sf), SEED).select(
        "pid", "lang", "q", "a", "lang_order_key", "order_key")


@query("d6_expand_single")
def d6(spark, sf):
    return D.expand_single(X.items(spark, sf), SEED)


@query("d7_rl_set")
def d7(spark, sf):
    it = X.items(spark, sf)
    return D.to_rl_set(it, "da", True).unionByName(D.to_rl_set(it, "da_en", True))


@query("d8_messages_en")
def d8(spark, sf):
    m = D.to_messages_en(X.items(spark, sf))
    return m.select("pid", F.posexplode("messages").alias("msg_idx", "m")).select(
        "pid", F.col("msg_idx").cast("long").alias("msg_idx"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


@query("d9_review_requests")
def d9(spark, sf):
    return D.review_requests(X.items(spark, sf))


@query("d10_translation_requests")
def d10(spark, sf):
    return D.translation_requests(X.items(spark, sf))


@query("d11_prepare_modes")
def d11(spark, sf):
    return D.prepare_modes(X.items(spark, sf), ("en", "da", "da_en"))


# ---- B: splits, order, sampling ------------------------------------------------

TRAIN_ROWS = 7473


@query("b1_split_by_position")
def b1(spark, sf):
    s = B.split_by_position(X.items(spark, sf).select("pid"), "pid", TRAIN_ROWS)
    return s.select("pid", F.col("position").cast("long").alias("position"), "part")


@query("b1_split_inside")
def b1_inside(spark, sf):
    """The same split with a cut inside the data at every scale."""
    s = B.split_by_position(X.items(spark, sf).select("pid"), "pid", 150)
    return s.select("pid", F.col("position").cast("long").alias("position"), "part")


@query("b2_head_subset")
def b2(spark, sf):
    # the head of the training part: one bounded top-k, no positions
    return B.head_subset(X.items(spark, sf).select("pid"), "pid", min(2000, TRAIN_ROWS))


@query("b3_sample_k")
def b3(spark, sf):
    return B.sample_k(X.items(spark, sf).select("pid"), "pid", 1000, SEED)


@query("b4_seeded_order")
def b4(spark, sf):
    return B.seeded_order(X.items(spark, sf).select("pid"), "pid", SEED)


# ---- H: attempts, review, resume -----------------------------------------------

@query("h1_parse_sections")
def h1(spark, sf):
    a = X.translation_attempts(spark, sf)
    return H.parse_sections(a).select("id", "attempt", "da_q", "da_a")


def _detect_profile(spark, sf):
    return profile(spark, sf, DETECT_LANGS)


@query("h2_accept_translations")
def h2(spark, sf):
    a = X.translation_attempts(spark, sf).where(F.col("error").isNull())
    acc = H.accept_translations(H.parse_sections(a), _detect_profile(spark, sf), TARGET, DETECT_LANGS)
    return acc.select("id", "attempt", "accepted")


def _translated(spark, sf):
    return H.first_accepted(X.items(spark, sf), X.translation_attempts(spark, sf),
                            _detect_profile(spark, sf), TARGET, DETECT_LANGS)


@query("h3_first_accepted")
def h3(spark, sf):
    return _translated(spark, sf)


@query("h4_pending_items")
def h4(spark, sf):
    done = _translated(spark, sf).where(F.col("da_question") != "")
    src = X.items(spark, sf).select(F.col("pid").alias("id"), "question", "answer")
    return H.pending_items(src, done).select("id")


def _translation_log(spark, sf, runs):
    """The attempts arrive in three parts; each of the first ``runs`` runs takes what has come."""
    from .runs import TranslationLog

    log = TranslationLog(spark, scratch_dir(spark, "translations"))
    items, attempts, prof = X.items(spark, sf), X.translation_attempts(spark, sf), _detect_profile(spark, sf)
    for i in range(runs):
        log.run(f"run-{i}", items, attempts.where(F.pmod("id", F.lit(3)) <= i), prof, TARGET, DETECT_LANGS)
    return log


@query("h3_translation_log")
def h3_log(spark, sf):
    """Three runs, each of which finds the earlier ones' items written."""
    return _translation_log(spark, sf, 3).translated()


@query("h4_pending_after_a_run")
def h4_log(spark, sf):
    return _translation_log(spark, sf, 1).pending(X.items(spark, sf)).select("id")


@query("h5_parse_reviews")
def h5(spark, sf):
    return H.parse_reviews(X.review_attempts(spark, sf)).drop("content", "error")


@query("h6_first_parseable")
def h6(spark, sf):
    return H.first_parseable(X.review_attempts(spark, sf), X.items(spark, sf))


@query("h7_is_issue")
def h7(spark, sf):
    r = H.first_parseable(X.review_attempts(spark, sf), X.items(spark, sf))
    return r.select("id", "verdict", H.is_issue(F.col("verdict")).alias("is_issue"))


def issue_report(spark, sf):
    return H.issue_report(X.items(spark, sf), H.first_parseable(X.review_attempts(spark, sf), X.items(spark, sf)))


@query("h8_issue_report")
def h8(spark, sf):
    return issue_report(spark, sf)


# ---- A: sources and sinks (round trips below the shared scratch folder) --------
from ..session import scratch_dir  # noqa: E402
from ..sources import io as IO  # noqa: E402
from ..streaming import incremental as ST  # noqa: E402
from ..streaming import scaling as RS  # noqa: E402


@query("a1_read_items_csv")
def a1(spark, sf):
    path = scratch_dir(spark, "items-csv")
    IO.write_items(X.items(spark, sf), path)
    return IO.read_items(spark, path)


@query("a2_read_source_tsv")
def a2(spark, sf):
    path = scratch_dir(spark, "source-tsv")
    src = X.items(spark, sf).select(F.col("pid").alias("id"), "question", "answer")
    IO.write_items(src, path, sep="\t")
    return IO.read_items(spark, path, sep="\t", schema=IO.SOURCE_SCHEMA)


@query("a3_write_issue_csv")
def a3(spark, sf):
    path = scratch_dir(spark, "issues-csv")
    report = issue_report(spark, sf)
    IO.write_items(report, path)
    return IO.read_items(spark, path, schema=report.schema)


@query("a4_write_metrics")
def a4(spark, sf):
    out = scratch_dir(spark, "metrics")
    wide = g12(spark, sf)
    IO.write_metrics(wide, out)
    return IO.read_metrics(spark, out, wide.schema, "json")


# ---- S: incremental jobs ---------------------------------------------------------

def _fitted_profile(spark, sf, languages=(TARGET, OTHER)):
    """Fit once and keep the model as a written table (no refit per batch)."""
    path = scratch_dir(spark, "profile")
    profile(spark, sf, languages).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _drop_files(spark, sf, base):
    """Write the completions as two arrivals (model m0 first, then the rest)."""
    comp = X.completions(spark, sf)
    first = comp.where(F.col("model") == "m0")
    rest = comp.where(F.col("model") != "m0")
    return [(first, f"{base}/drop_1"), (rest, f"{base}/drop_2")]


def _stream_scored(spark, sf, metrics=False):
    base = scratch_dir(spark, "stream")
    src, sink, ckpt = f"{base}/in", f"{base}/scored", f"{base}/ckpt-score"
    items, prof = X.items(spark, sf), _fitted_profile(spark, sf)
    for df, path in _drop_files(spark, sf, src):
        df.write.mode("overwrite").parquet(path)
        # A restart per arrival: the checkpoints skip files already read.
        ST.stream_score(spark, f"{src}/*", sink, ckpt, items, prof, TARGET, OTHER,
                        counters_dir=f"{base}/language" if metrics else None)
        if metrics:
            ST.stream_metrics(spark, f"{src}/*", f"{base}/metrics", f"{base}/ckpt-metrics", items)
    return base, ST.read_scored(spark, sink)


@query("s1_stream_score")
def s1(spark, sf):
    _, scored_rows = _stream_scored(spark, sf)
    return _scored_out(scored_rows)


@query("s2_stream_metrics")
def s2(spark, sf):
    base, _ = _stream_scored(spark, sf, metrics=True)
    counts = ST.read_metrics(spark, f"{base}/metrics")
    lang = ST.running_language(spark, f"{base}/language")
    return counts.join(lang, ["model", "mode"], "left").select(
        "model", "mode", "rows", "correct", "boxed", "target", "other", "mixed", "unclear",
        r6("score_sum").alias("score_sum"))


def _running_scaling(spark, sf):
    """The samples as two arrivals, each with some samples of the same prompts; the stream stops and
    starts again between them, and the second arrival's tables are merged with the first's."""
    base = scratch_dir(spark, "running")
    state = RS.RunningScaling(spark, f"{base}/state", max(NS))
    comp, items, prof = X.completions(spark, sf), X.items(spark, sf), profile(spark, sf)
    for i in (0, 1):
        arrival = comp.where(F.pmod(F.col("pid") + F.col("sample_idx"), F.lit(2)) == i)
        arrival.write.parquet(f"{base}/in/drop_{i}")
        RS.stream_scaling(spark, f"{base}/in/*", state, items, prof, TARGET, OTHER)
    return state, items


@query("s3_running_scaling")
def s3(spark, sf):
    state, items = _running_scaling(spark, sf)
    keys = ["model", "mode", "n"]
    out = state.best_of_n(items, NS).join(state.majority(items, NS), keys).join(state.language_mix(items, NS), keys, "left")
    return _round_all(out.withColumn("n", F.col("n").cast("long")), keys)


@query("s4_running_winners")
def s4(spark, sf):
    state, _ = _running_scaling(spark, sf)
    return _winner_columns(state.winners(NS))
