"""Quality rules by distribution divergence.

Every document gets two histograms: its character classes, and its common
words (a short function-word list per language, plus one bin for all other
words).  A language's reference is the pooled histogram of all documents that
declare the language.  A document of a language with a word list, or of no
declared language, is held against the nearest of those languages; a document
of any other language against the character classes of its own, if the table
has enough text of it.  The measure is the Jensen-Shannon distance (base 2, 0
to 1); documents whose distance passes a limit are rejected.  Texts below a
minimum length have too few observations for a histogram and are not judged by
that histogram.

Only DataFrame functions: histograms are arrays inside the row, so nothing is
shuffled but one row of sums per task and language.

Defined results: null or empty text has no words, hence ``base_failed``;
repeated rows are judged alike; a document without a reference is judged by
the base rules alone, so on an empty table and in a language with little
text; a text of any length is read whole; a distance at a limit passes;
columns other than id, text and language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import LOWER, UPPER, packed, words, written

#: Frequent function words of each reference language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una"],
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SYMBOLS = "#*$%&|<>"
#: Character classes; what is left after the listed ones is "other" (letters beyond ASCII, rare marks).
CLASSES = {"lower": LOWER, "upper": UPPER, "digit": "0123456789", "space": " \t\n\x0b\x0c\r",
           "mark": ".,;:!?'\"()-", "symbol": SYMBOLS + "@^_`{}~[]\\/+="}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50              # base rule
    max_repeat_percent: int = 50     # base rule
    char_min: int = 200              # word characters a character histogram needs
    word_min: int = 100              # words a common-word histogram needs
    char_limit: float = 0.25         # Jensen-Shannon distance
    word_limit: float = 0.25
    languages: tuple[str, ...] = field(default=tuple(COMMON_WORDS))
    ref_words: int = 2_000           # pooled words the reference of any other language needs
    broadcast_languages: int = 10_000


def _class_counts(text: Column) -> Column:
    """Counts per character class: each class is deleted in turn and the loss
    of length is its count."""
    rest, counts = text, []
    for chars in CLASSES.values():
        nxt = F.translate(rest, chars, "")
        counts.append(F.length(rest) - F.length(nxt))
        rest = nxt
    return F.array(*counts, F.length(rest))




def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: the packed input row, base counts and histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    first = docs.select(packed(docs), text.alias("_t"), lang.alias("_lang"))
    w = first.select("_row", "_t", "_lang", words(F.col("_t")).alias("_w"))
    n = F.size("_w")
    a = w.select(
        "_row", "_lang", "_w", n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("_tri"),
        F.filter("_w", lambda x: F.lower(x).isin(VOCABULARY)).alias("_hits"),
        _class_counts(F.col("_t")).alias("char_counts"))
    # hash and position sorted together: equal windows become neighbours
    b = a.select(
        "*", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_hits", lambda x: F.lower(x)).alias("_low"),
        F.when(F.size(F.array_distinct("_tri")) < F.size("_tri"),
               F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
        .alias("_at"))
    c = b.select(
        "*", F.size("_low").alias("_n_hits"),
        F.sort_array(F.transform(
            F.filter("_at", lambda x, j: (F.get(F.col("_at"), j + 1)["h"] == x["h"])
                     | ((j > 0) & (F.get(F.col("_at"), F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))),
            lambda x: x["p"])).alias("_pos"))
    covered = F.aggregate(
        F.col("_pos"), F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"])
    counts = F.transform(F.array(*[F.lit(v) for v in VOCABULARY]),
                         lambda v: F.size(F.filter(F.col("_low"), lambda x: x == v)))
    return c.select("_row", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "char_counts",
                    F.when(F.col("_n_hits") > 0, counts).otherwise(
                        F.array_repeat(F.lit(0), len(VOCABULARY))).alias("word_counts"),
                    # a filter on the verdict must not be pushed below this step: it would repeat
                    # the array work inside its own lambdas
                    F.monotonically_increasing_id().alias("_at_row"))


def language_sums(features: DataFrame) -> DataFrame:
    """Pooled histograms: one row per declared language."""
    return features.groupBy("_lang").agg(
        *[F.sum(F.get("char_counts", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)],
        *[F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(len(VOCABULARY))],
        F.sum("n_words").alias("n"))


def listed_references(sums: DataFrame, rules: QualityRules) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of classes and common words of each listed language: at most one
    row per listed language reaches the driver."""
    out = {}
    for r in sums.where(F.col("_lang").isin(list(rules.languages))).collect():
        chars = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        own = [r[f"w{VOCABULARY.index(v)}"] for v in COMMON_WORDS[r["_lang"]]]
        if sum(chars) and r["n"]:
            out[r["_lang"]] = ([c / sum(chars) for c in chars],
                               [c / r["n"] for c in [*own, r["n"] - sum(own)]])
    return dict(sorted(out.items()))


def fit_references(features: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, tuple[list[float], list[float]]]:
    """References of the listed languages, over all their documents."""
    return listed_references(language_sums(features.where(F.col("_lang").isin(list(rules.languages)))), rules)


def other_references(sums: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(``_own``, ``_ref``): the class shares of every other language with
    enough text."""
    chars = [F.col(f"c{i}") for i in range(len(CLASSES) + 1)]
    total = sum(chars[1:], chars[0])
    return (sums.where(F.col("_lang").isNotNull() & ~F.col("_lang").isin(list(rules.languages))
                       & (F.col("n") >= rules.ref_words) & (total > 0))
            .select(F.col("_lang").alias("_own"), F.array(*[c / total for c in chars]).alias("_ref")))


def judge(features: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """References from all of ``features`` (read twice: better a written
    table), then the verdicts."""
    sums = written(language_sums(features), "quality-references")
    return judged(features, listed_references(sums, rules), rules, other_references(sums, rules))


def js_distance(counts: list[Column], total: Column, ref: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts/total to a reference."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    ref = ref if isinstance(ref, Column) else F.array(*[F.lit(float(q)) for q in ref])
    terms = F.zip_with(F.array(*[(c / total) for c in counts]), ref,
                       lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judged(features: DataFrame, refs: dict, rules: QualityRules = QualityRules(), others: DataFrame | None = None) -> DataFrame:
    """Adds ``char_js``, ``word_js``, ``base_failed`` and ``kept``.  Documents
    of the listed languages or of none are held against the nearest listed
    reference, documents of another language against its own in ``others``;
    distances are null below the minimum lengths and without a reference."""
    columns = features.columns
    n_others = others.count() if others is not None else 0
    if n_others:
        # a row of seven shares per language
        others = F.broadcast(others) if n_others <= rules.broadcast_languages else others
        features = features.join(others, F.col("_lang") == F.col("_own"), "left")
    chars = [F.get("char_counts", F.lit(i)) for i in range(len(CLASSES) + 1)]
    n_chars = F.aggregate("char_counts", F.lit(0), lambda s, x: s + x)

    def nearest(parts):
        return F.least(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast("double")
    char_js = nearest([js_distance(chars, n_chars, c) for c, _ in refs.values()])
    listed = F.col("_lang").isNull() | F.col("_lang").isin(list(rules.languages))
    own_js = F.lit(None).cast("double")
    if n_others:
        own_js = F.when(F.col("_ref").isNotNull(), js_distance(chars, n_chars, F.col("_ref")))
    char_js = F.when(listed, char_js).otherwise(own_js)
    by_word = {}
    for lang, (_, ref) in refs.items():
        own = [F.get("word_counts", F.lit(VOCABULARY.index(v))) for v in COMMON_WORDS[lang]]
        by_word[lang] = js_distance([*own, F.col("n_words") - sum(own[1:], own[0])], F.col("n_words"), ref)
    out = features.select(
        *columns, F.when(F.col("word_chars") >= rules.char_min, char_js).alias("char_js"),
        F.when(listed & (F.col("n_words") >= rules.word_min), nearest(list(by_word.values()))).alias("word_js"),
        ((F.col("n_words") < rules.min_words)
         | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"))
    return out.select("*", (~F.col("base_failed")
                            & F.coalesce(F.col("char_js") <= rules.char_limit, F.lit(True))
                            & F.coalesce(F.col("word_js") <= rules.word_limit, F.lit(True)) & (F.col("_at_row") >= 0)).alias("kept"))
