"""Registered queries of the training-data operators, and their SQL.

Each query applies its operator with production parameters to its whole table.
Where SQL can't express the operator the second entry is None and tests hold
the query against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margincast.llm import (brown_lm, collision_ann, license_scan, line_dedup, mixing, ngram_join, packing, phrases, pii, quality,
                            simhash_ring, spelling, toxicity)
from margincast.llm.common import LOWER, UPPER, read, written


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- 1. licence scans ----

def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def _license_sql() -> str:
    table = ", ".join(f"({_q(s)}, {_q(i)})" for s, i in license_scan.SENTENCES.items())
    steps, last = [], "ids"
    for i, (_, names) in enumerate(license_scan.RULES):
        pattern = _q("".join(f"<{n}>" for n in names))
        steps.append(f"r{i} AS (SELECT *, contains(s{i}, {pattern}) AS h{i}, replace(s{i}, {pattern}, '|') AS s{i + 1} FROM {last})")
        last = f"r{i}"
    hits = ", ".join(f"CASE WHEN h{i} THEN {_q(name)} END" for i, (name, _) in enumerate(license_scan.RULES))
    return f"""
WITH t(s, i) AS (VALUES {table}),
m AS (SELECT map(list(s), list(i)) AS m FROM t),
sent AS (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                '{license_scan.SENTENCE_END}') AS parts FROM documents),
known AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: m.m[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]),
                 lambda x: x IS NOT NULL) AS l FROM sent, m),
ids AS (SELECT doc_id, len(l) AS n_sentences, coalesce(array_to_string(l, ','), '') AS sentence_ids,
               coalesce(array_to_string(list_transform(l, lambda x: '<' || x || '>'), ''), '') AS s0 FROM known),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids,
       coalesce(array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter([{hits}], lambda x: x IS NOT NULL),
                lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ','), '') AS licenses,
       regexp_replace(replace(replace(s{len(license_scan.RULES)}, '|', ''), '><', ','), '[<>]', '', 'g') AS unmatched
FROM {last}"""


# ---- 2. packing ----

def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


# ---- 3. quality rules ----

def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.text_features(read(spark, sf_dir, "documents"))
    # counts only, without the texts: written once, read for the references and again for the verdicts
    rest = [c for c in features.columns if c != "_row"]
    features = written(features.select(F.struct("_row.doc_id").alias("_row"), *rest), "quality-counts")
    return quality.judge(features).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _quality_sql() -> str:
    rules, voc = quality.QualityRules(), quality.VOCABULARY
    ws = r"[\x20\x09-\x0D]+"
    names = list(quality.CLASSES)
    rest, cls = "t", []
    for i, (name, chars) in enumerate(quality.CLASSES.items()):
        sql = "'" + chars.replace("'", "''") + "'"
        cls.append(f"c{i} AS (SELECT *, translate({rest}, {sql}, '') AS t{i}, length({rest}) - length(translate({rest}, {sql}, '')) "
                   f"AS n_{name} FROM {'w' if not i else f'c{i - 1}'})")
        rest = f"t{i}"
    last = f"c{len(names) - 1}"
    counts = ", ".join(f"n_{n}" for n in names)
    word_counts = ", ".join(f"len(list_filter(low, lambda x: x = {_q(v)}))" for v in voc)
    n_char = len(names) + 1
    char_sums = ", ".join(f"sum(cc[{i + 1}])::DOUBLE" for i in range(n_char))
    refs, dist_c, dist_w = [], [], []
    for lang in rules.languages:
        own = [voc.index(v) + 1 for v in quality.COMMON_WORDS[lang]]
        refs.append(f"""ref_{lang} AS (SELECT [{char_sums}] AS c, [{", ".join(f"sum(wc[{i}])::DOUBLE" for i in own)},
  sum(n_words - ({" + ".join(f"wc[{i}]" for i in own)}))::DOUBLE] AS w, sum(n_words)::DOUBLE AS n FROM f WHERE lang = {_q(lang)})""")

        def js(p, q):
            # a language without documents has no reference and no distance
            return (f"CASE WHEN isfinite({q}[1]) THEN sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
                    "(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END "
                    "+ CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)), 0)) END")
        dist_c.append(js("list_transform(cc, lambda x: x / list_sum(cc))",
                         f"(SELECT list_transform(c, lambda x: x / list_sum(c)) FROM ref_{lang})"))
        dist_w.append(js(f"[{', '.join(f'wc[{i}] / n_words' for i in own)}, (n_words - ({' + '.join(f'wc[{i}]' for i in own)})) / n_words]",
                         f"(SELECT list_transform(w, lambda x: x / n) FROM ref_{lang})"))
    listed = ", ".join(map(_q, rules.languages))
    own_js = js("list_transform(cc, lambda x: x / list_sum(cc))", "list_transform(oc, lambda x: x / list_sum(oc))")
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w FROM documents),
{", ".join(cls)},
tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             [{counts}, length({rest})] AS cc, [{word_counts}] AS wc
      FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
                   list_transform(w, lambda x: lower(x)) AS low FROM {last}) d LEFT JOIN cov USING (doc_id)),
{", ".join(refs)},
other AS (SELECT lang AS own, [{char_sums}] AS oc FROM f WHERE lang NOT IN ({listed}) GROUP BY lang
          HAVING sum(n_words) >= {rules.ref_words} AND sum(list_sum(cc)) > 0),
j AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
             CASE WHEN word_chars < {rules.char_min} THEN NULL WHEN coalesce(lang IN ({listed}), true) THEN least({", ".join(dist_c)})
                  WHEN own IS NOT NULL THEN {own_js} END AS char_js,
             CASE WHEN n_words >= {rules.word_min} AND coalesce(lang IN ({listed}), true) THEN least({", ".join(dist_w)}) END AS word_js
      FROM f LEFT JOIN other ON lang = own)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_js <= {rules.char_limit}, true) AND coalesce(word_js <= {rules.word_limit}, true) AS kept
FROM j"""


# ---- 4. toxicity ----

def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = read(spark, sf_dir, "documents"), toxicity.ToxicityRules()
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), rules), rules)


# ---- 5. nearest neighbours ----

def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(read(spark, sf_dir, "embeddings"))


# ---- 6. n-gram Jaccard join ----

def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def _jaccard_sql() -> str:
    rules = ngram_join.JaccardRules()
    n = rules.n
    gram = " || ' ' || ".join(f"w[p + {i}]" if i else "w[p]" for i in range(n))
    return f"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'),
             lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS p FROM w WHERE len(w) >= {n})
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {n - 1}),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
         JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {rules.percent} * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents
          UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT v AS doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN size ON size.doc_id = v GROUP BY v"""


# ---- 7. line dedup ----

def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("_text"), 256).alias("kept_sha256"))


def _line_sql() -> str:
    rules = line_dedup.LineRules()
    key = (f"translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), "
           f"'{UPPER}', '{LOWER}')")
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT doc_id, p, line, {key} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {rules.min_chars}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {rules.min_docs}),
d AS (SELECT k.doc_id, p, line, coalesce(r.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""


# ---- 8. language model ----

def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_lm(read(spark, sf_dir, "documents"))


# ---- 9. mixing ----

def op9_mix_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source")).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_source").alias("source"), "block", "slot", "place")


# ---- 10. personal data ----

def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added",
        F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


# ---- 11. SimHash near-duplicates ----

def op11_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.near_duplicates(read(spark, sf_dir, "documents"))


# ---- 12. spelling variants ----

#: One distinct word of a document in so many loses a code point.
TYPO_DIVISOR = 199


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spelling.SpellingRules()
    words = spelling.word_counts(read(spark, sf_dir, "documents"), rules, typo_divisor=TYPO_DIVISOR)
    return spelling.group_variants(words, rules)


def _spelling_sql() -> str:
    rules = spelling.SpellingRules()
    return f"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
               lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
        WHERE length(run) >= {rules.min_chars} GROUP BY ALL),
hashed AS (SELECT run, k, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
             list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), (2 * i - 1)::INT, 2))::UBIGINT)),
             lambda c, x: xor(c >> 8, crc.t[((xor(c, x) & 255) + 1)::BIGINT]))) AS h
           FROM (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM run), crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT CASE WHEN h % {TYPO_DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                    ELSE run END AS word, k FROM hashed)
      WHERE length(word) >= {rules.min_chars} GROUP BY word HAVING sum(k) >= {rules.min_count}),
gone AS (SELECT word, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS v
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT DISTINCT a.word, b.word AS other FROM gone a JOIN gone b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
         UNION SELECT g.word, g.v FROM gone g JOIN w ON w.word = g.v
         UNION SELECT g.v, g.word FROM gone g JOIN w ON w.word = g.v),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS n
         FROM near JOIN w ON w.word = other GROUP BY near.word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {rules.ratio} * w.n THEN other END AS form,
                CASE WHEN best.n >= {rules.ratio} * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
up AS (SELECT word, word AS root, 0 AS d FROM form UNION ALL
       SELECT up.word, form.form, d + 1 FROM up JOIN form ON form.word = up.root WHERE form.form IS NOT NULL)
SELECT form.word, form, r.root, n, n_near, form_n
FROM form JOIN (SELECT word, arg_max(root, d) AS root FROM up GROUP BY word) r ON r.word = form.word"""


# ---- 13. phrase collocations ----

def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def _phrase_sql() -> str:
    rules = phrases.PhraseRules()
    top = rules.max_words
    follow = ", ".join(f"lead(w, {i}) OVER p AS w{i + 1}" for i in range(1, top))
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, k + 1))}) AS phrase, count(*) AS f "
        f"FROM t WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= {rules.min_count}" for k in range(1, top + 1))
    return f"""
WITH piece AS (SELECT lang, row_number() OVER () AS pid, p FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
word AS (SELECT lang, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i
         FROM (SELECT lang, pid, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece)),
t AS (SELECT lang, w1, {follow.replace('lead(w,', 'lead(w1,')} FROM word WINDOW p AS (PARTITION BY pid ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
g AS ({grams}),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
cut AS (SELECT c.lang, c.phrase, c.a, n, k, x.f AS l, y.f AS r,
               (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c JOIN total USING (lang)
        JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
        JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
scored AS (SELECT lang, phrase, a, n, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score)::BIGINT AS score
           FROM cut GROUP BY ALL),
around AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS around
           FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM cand)) GROUP BY ALL),
best AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
         FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
         WHERE o.around IS NULL OR 100 * o.around < {rules.percent} * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best WHERE rank <= {rules.top}"""


REGISTRY = {
    "op1_license_scan": (op1_license_scan, _license_sql()),
    "op2_bm25_packing": (op2_bm25_packing, None),
    "op3_quality_rules": (op3_quality_rules, _quality_sql()),
    "op4_toxicity_fm": (op4_toxicity_fm, None),
    "op5_collision_ann": (op5_collision_ann, None),
    "op6_ngram_jaccard": (op6_ngram_jaccard, _jaccard_sql()),
    "op7_line_dedup": (op7_line_dedup, _line_sql()),
    "op8_brown_lm": (op8_brown_lm, None),
    "op9_mix_pfair": (op9_mix_pfair, None),
    "op10_pii_spans": (op10_pii_spans, None),
    "op11_simhash_ring": (op11_simhash_ring, None),
    "op12_spelling_variants": (op12_spelling_variants, _spelling_sql()),
    "op13_son_phrases": (op13_son_phrases, _phrase_sql()),
}
