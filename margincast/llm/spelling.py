"""Spelling variants by asymmetric q-chunks.

Words are counted first; then words one edit apart are joined.  The shorter word
of a pair (either, if as long) is cut into two disjoint chunks, its halves; the
longer gives positional grams as long as those chunks.  One edit touches one of
the halves, so the other is a gram of the longer word, shifted by at most one
place: the join is on chunk, half and the shorter word's length, with grams only
at places within shift one.  What meets is screened by the letters of the words
(one edit adds and removes one letter at most) and verified by edit distance.

Everything runs in DataFrame functions.

Defined results: a null or empty text has no word; a null id counts as an empty
one where ids enter the damage rule; repeated rows count again; words of equal
count tie to the smaller one in code-point order; a word as long as a whole text
is a word like any other; an empty table gives no rows; only the id and text
columns are read, so names of others can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import LOWER, UPPER, discard, written

LETTERS = r"A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class SpellingRules:
    min_chars: int = 6
    min_count: int = 5
    #: A form is at least this many times as frequent as its variant.
    ratio: int = 5


def with_typos(run: Column, doc_id: Column, divisor: int) -> Column:
    """The run, without one code point where ``divisor`` divides the CRC-32 of
    ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % divisor == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, rules: SpellingRules = SpellingRules(), id_col: str = "doc_id", text_col: str = "text",
                typo_divisor: int | None = None) -> DataFrame:
    """``word, n`` of words long and frequent enough.  ``typo_divisor`` damages
    words on the way, so that a corpus holds known variants."""
    # runs only get shorter by damage, so short ones can't become words
    runs = (docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{rules.min_chars},}}"), F.lit(0))).alias("run")))
    word = F.col("run") if typo_divisor is None else with_typos(F.col("run"), F.col("id"), typo_divisor)
    return (runs.select(word.alias("word")).where(F.char_length("word") >= rules.min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.min_count))


def letter_set(word: Column) -> Column:
    """The letters of a word as bits of a long (code points folded to 64)."""
    return F.aggregate(F.transform(F.split(word, ""), lambda ch: F.ascii(ch)), F.lit(0).cast("long"),
                       lambda acc, ch: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(ch, F.lit(64)))))


def near_pairs(words: DataFrame) -> DataFrame:
    """``x, y``: words (word) exactly one inserted, deleted or replaced code
    point apart; every pair once."""
    base = words.select("word", F.char_length("word").alias("len"), letter_set(F.col("word")).alias("letters"))
    base = written(base, "spelling-words")
    half = F.floor(F.col("len") / 2).cast("int")
    chunks = base.select(
        F.col("word").alias("x"), F.col("letters").alias("xs"), F.col("len").alias("size"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("half"), F.substring("word", F.lit(1), half).alias("chunk")),
            F.struct(F.lit(1).alias("half"), F.substring("word", half + 1, F.col("len")).alias("chunk")))).alias("c"))
    # grams for partners of the same length and one shorter; places count from 0
    sized = base.select("word", "letters", "len", F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("size"))
    cut = F.floor(F.col("size") / 2).cast("int")
    places = F.array(*[F.struct(F.lit(h).alias("half"), (at + shift).alias("place"), width.alias("width"))
                       for h, at, width in ((0, F.lit(0), cut), (1, cut, F.col("size").cast("int") - cut))
                       for shift in (-1, 0, 1)])
    inside = F.filter(places, lambda p: (p["place"] >= 0) & (p["place"] + p["width"] <= F.col("len")))
    cuts = F.array_distinct(F.transform(inside, lambda p: F.struct(
        p["half"].alias("half"), F.substring(F.col("word"), p["place"] + 1, p["width"]).alias("chunk"))))
    grams = (sized.select(F.col("word").alias("y"), F.col("letters").alias("ys"), "size", F.explode(cuts).alias("c"))
             .select("y", "ys", "size", F.col("c.half").alias("half"), F.col("c.chunk").alias("chunk")))
    left = chunks.select("x", "xs", "size", F.col("c.half").alias("half"), F.col("c.chunk").alias("chunk")).alias("l")
    right = grams.alias("r")
    same = ((F.col("l.size") == F.col("r.size")) & (F.col("l.half") == F.col("r.half")) & (F.col("l.chunk") == F.col("r.chunk")))
    screen = ((F.bit_count(F.col("l.xs").bitwiseXOR(F.col("r.ys"))) <= 2)
              & ((F.char_length("r.y") > F.col("l.size")) | (F.col("l.x") < F.col("r.y")))
              & (F.levenshtein("l.x", "r.y", 1) == 1))
    return left.join(right, same & screen).select("x", "y").distinct()


def group_variants(words: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of counted words (word, n)."""
    spark = words.sparkSession
    held = written(words, "spelling-counts")
    pairs = written(near_pairs(held.select("word")), "spelling-pairs")
    both = pairs.union(pairs.select("y", "x")).toDF("word", "near")
    best = (both.join(held.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")))
    strong = -F.col("b.m") >= rules.ratio * F.col("n")
    named = written(held.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("b.near")).alias("form"), F.when(strong, -F.col("b.m")).alias("form_n")), "spelling-forms")
    # counts grow by the ratio at every step, so paths are short and have no
    # cycle; every round doubles the length of the known part
    roots = written(named.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(spark, roots)
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return (named.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
