"""Spelling variants: near words (one edit apart) found by pivotal grams, and the usual form of each word.

A word's bigrams, with their positions, are put in one global order, rarest first.  Its *prefix* is the three rarest
and the next that equal the last of them (``TIES``); its *pivots* are two disjoint ones of the three with the least sum of frequencies, chosen by
dynamic programming over the positions.  One edit spoils at most one of two disjoint bigrams, so a pivot of the word whose prefix ends earlier in the
order stands in the prefix of every near word, moved by one place at most.  The edit then lies on one side of it.  Pivots are looked up in the
prefixes by position, length, the whole other side, and one half of the edited side (``stored_keys``), as bigrams alone are
too few to tell many words apart.  Candidates are settled by an edit distance cut off at one.

All steps are DataFrame expressions.  The table of bigram frequencies is bounded by the alphabet: 26 letters and the 64 code points U+00C0 to
U+00FF give at most 90 * 90 rows, whatever the corpus, which is what its broadcast rests on.  Long lists of one key are cut
into blocks of ``LIST`` words, so that no key is one task.  Only verified pairs leave the lookup.

Defined cases: null and empty texts hold no words; a null doc_id counts as empty text before the colon; a run of one code point
that is deleted leaves no word; repeated rows count again, as occurrences; ties among forms go to the smallest word
in code-point order; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, text_of, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Fixed values of the contract: the runs of letters, and one run in 31 that loses a code point.
RUN, DROP_ONE_IN = r"[A-Za-zÀ-ÿ]+", 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one list that one task compares with the pivots that meet them.
LIST = 4096
#: Grams of a prefix: one edit spoils two bigrams at most, and a third must be left.  A pivot has at most PREFIX - 1 equal
#: bigrams before it, and an edit makes two more at most, so that the first TIES occurrences of a prefix's last bigram are enough.
PREFIX, TIES = 3, 5


def runs(documents: DataFrame) -> DataFrame:
    """(run): every run of every text, A-Z lower-cased; one in 31 loses a code point."""
    run = F.explode(F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1)))
    r = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), run.alias("r"))
    h = F.crc32(F.concat("d", F.lit(":"), "r").cast("binary"))
    r = r.select("r", h.alias("h"), F.char_length("r").alias("n"))
    at = F.pmod(F.col("h"), F.col("n")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.col("n")))
    return r.select(F.when(F.col("h") % DROP_ONE_IN == 0, cut).otherwise(F.col("r")).alias("run"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least_length`` code points and ``least_count`` occurrences."""
    counts = words.filter(F.char_length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def bigrams(word: str = "word") -> Column:
    """The bigrams of a word in order; the characters are split once, so long words cost their length."""
    chars = F.split(F.col(word), "")
    return F.zip_with(F.slice(chars, 1, F.char_length(word) - 1), F.slice(chars, 2, F.char_length(word) - 1), lambda a, b: F.concat(a, b))


def pivots(prefix: Column) -> Column:
    """Two disjoint bigrams of ``prefix`` (freq, gram, pos) with the least sum of frequencies.

    Dynamic programming over the positions: the best single bigram that ends before a place is known when a
    bigram that starts there is paired with it.  A bigram covers two places, so partners lie two or more apart."""
    by_place = F.array_sort(F.transform(prefix, lambda g: F.struct(g["pos"].alias("pos"), g["freq"].alias("freq"), g["gram"].alias("gram"))))
    none = F.lit(None).cast("struct<freq:bigint,gram:string,pos:int>")
    start = F.struct(none.alias("one"), none.alias("held"),
                     F.lit(None).cast("struct<cost:bigint,a:struct<freq:bigint,gram:string,pos:int>,b:struct<freq:bigint,gram:string,pos:int>>").alias("two"))

    def step(state, g):
        # ``one``: the best single bigram at places up to g.pos - 2; ``held``: the one at g.pos - 1, if it is in the prefix
        gram = F.struct(g["freq"].alias("freq"), g["gram"].alias("gram"), g["pos"].alias("pos"))
        held_ends = state["held"].isNotNull() & (state["held"]["pos"] <= g["pos"] - 2)
        one = F.when(held_ends, F.least(state["one"], state["held"])).otherwise(state["one"])
        near = F.when(held_ends, none).otherwise(state["held"])
        pair = F.when(one.isNotNull(), F.struct((one["freq"] + g["freq"]).alias("cost"), one.alias("a"), gram.alias("b")))
        # a bigram held at g.pos - 1 is free for partners from g.pos + 1 on, that is from the next step
        return F.struct(F.when(near.isNotNull(), F.least(one, near)).otherwise(one).alias("one"), gram.alias("held"), F.least(state["two"], pair).alias("two"))

    return F.aggregate(by_place, start, step, lambda s: F.array(s["two"]["a"], s["two"]["b"]))


def indexed(words: DataFrame) -> DataFrame:
    """(word, len, prefix, pivots): the chosen bigrams of every word; one shuffle of (word, bigram) rows."""
    grams = words.select("word", F.char_length("word").alias("len"), F.posexplode(bigrams()).alias("pos", "gram"))
    freq = grams.groupBy("gram").agg(F.count("*").alias("freq"))
    each = grams.join(F.broadcast(freq), "gram")  # at most 90 * 90 rows
    rows = each.groupBy("word", "len").agg(F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))).alias("g"))
    first = F.slice("g", 1, PREFIX)
    last = F.element_at("g", PREFIX)
    rarer = F.filter(first, lambda x: (x["freq"] < last["freq"]) | (x["gram"] < last["gram"]))
    ties = F.slice(F.filter("g", lambda x: x["gram"] == last["gram"]), 1, TIES)
    return rows.select("word", "len", F.concat(rarer, ties).alias("prefix"), pivots(first).alias("pivots"))


def _key(side: str, length: Column, pos: Column, *texts: Column) -> Column:
    """What two words have in common if the edit lies on one side of a shared bigram; 64-bit hashes, as candidates are verified."""
    return F.xxhash64(F.lit(side), length.cast("int"), pos.cast("int"), *texts)


def _cut(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, start.cast("int") + 1, F.greatest(length, F.lit(0)).cast("int"))


def stored_keys(word: Column, length: Column, pos: Column) -> Column:
    """The keys under which a word stands for a bigram of its prefix at ``pos``.

    The edit that a near word has lies right or left of the bigram.  The other side is the same in both words; of the
    edited side, cut in two halves, one half is the same, counted from its own end of the word."""
    right, left = F.floor((length - pos - 2) / 2), F.floor(pos / 2)
    return F.array(_key("right, first half", length, pos, _cut(word, F.lit(0), pos + 2 + right)),
                   _key("right, second half", length, pos, _cut(word, F.lit(0), pos + 2), _cut(word, pos + 2 + right, length)),
                   _key("left, first half", length, pos, _cut(word, F.lit(0), left), _cut(word, pos, length)),
                   _key("left, second half", length, pos, _cut(word, left, length)))


def asked_keys(word: Column, length: Column, pos: Column) -> Column:
    """The keys of all words one edit from ``word`` that keep its pivot at ``pos``: as long as it, or one code point shorter or longer."""
    keys = []
    for more in (-1, 0, 1):
        other = length + more
        # right of the pivot: it stands at the same place
        edited = other - pos - 2
        half = F.floor(edited / 2)
        keys += [F.when(edited >= 0, _key("right, first half", other, pos, _cut(word, F.lit(0), pos + 2 + half))),
                 F.when(edited >= 0, _key("right, second half", other, pos, _cut(word, F.lit(0), pos + 2), _cut(word, length - edited + half, length)))]
        # left of the pivot: it moves as the length does
        edited = pos + more
        half = F.floor(edited / 2)
        keys += [F.when(edited >= 0, _key("left, first half", other, edited, _cut(word, F.lit(0), half), _cut(word, pos, length))),
                 F.when(edited >= 0, _key("left, second half", other, edited, _cut(word, F.greatest(pos - edited + half, F.lit(0)), length)))]
    return F.array_compact(F.array(*keys))


def near_pairs(words: DataFrame, list_words: int = LIST) -> DataFrame:
    """(a, b), a < b: the words one edit apart; each pair once."""
    index = written(indexed(words), "spelling-index")
    word, length, pos = F.col("word"), F.col("len"), F.col("pos")
    stored = index.select("word", "len", F.explode("prefix.pos").alias("pos")).select(F.explode(stored_keys(word, length, pos)).alias("key"), F.col("word").alias("b"))
    asked = index.select("word", "len", F.explode("pivots.pos").alias("pos")).select(F.explode(asked_keys(word, length, pos)).alias("key"), F.col("word").alias("a"))
    # lists of very many words are cut into blocks; there are fewer such keys than stored rows / list_words
    long = written(stored.groupBy("key").agg(F.ceil(F.count("*") / list_words).cast("int").alias("blocks")).filter("blocks > 1"), "spelling-long-lists")
    n_long = long.count()
    if n_long:
        side = F.broadcast(long) if n_long <= BROADCAST_ROWS else long
        blocks = F.coalesce("blocks", F.lit(1))
        stored = stored.join(side, "key", "left").select("key", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"), "b")
        asked = asked.join(side, "key", "left").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "a")
    met = asked.join(stored, ["key", "block"] if n_long else "key").filter("a <> b").filter(F.levenshtein("a", "b", 1) == 1)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of a table (word, n) of distinct words.

    ``form``: the near word of largest n, if that is ``factor`` times the word's n or more; ``root``: the last word that
    is reached by following forms.  Counts grow by ``factor`` at each step, so that a chain in 64-bit counts has fewer than
    64 steps (``factor`` 2 or more) and six doublings of the followed forms reach its end."""
    if factor < 2:
        raise ValueError("a form has at least twice the occurrences")
    words = written(words.select("word", "n"), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a word has at most (2 * length + 1) * 90 near words: no group is large
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    near = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b"))).alias("best"))
    out = words.join(near, "word", "left")
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.b"))
    out = written(out.select("word", "n", form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"),
                             F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "spelling-forms")
    # only words that have a form move; their number bounds the doubling
    up = out.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out.join(up, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def report(documents: DataFrame) -> DataFrame:
    """The spelling groups of the words of all documents."""
    return group(vocabulary(runs(documents))).select("word", "form", "root", "n", "n_near", "form_n")
