"""Personal-data recognition: propose, validate, weigh the context.

Each recogniser has a regular expression that proposes spans (leftmost, not
overlapping), a validator (Luhn, mod-97, octet and digit-count checks) and a
score.  Context words in the 48 characters before or after a span raise its
score, also where other spans lie between (behind a span a word before "=" or
":" doesn't count); a span is reported when its score reaches the threshold.  The four base kinds
(email, ip, card, phone) score above the threshold once valid, so context
can't remove them; the added kinds (IBAN, national id, secret tokens) need a
checksum or context.

Only DataFrame functions.  Splitting a text at a pattern gives the pieces
between the matches, so a span's position is the running length of pieces and
matches: one pass, no search for the match text.  Look-behinds keep a pattern
from being retried inside the run it already failed on; ``\\G`` keeps the
place where the last match ended allowed.

Defined results: null text counts as empty; a text without spans has empty
``spans`` and the hash of the empty string; repeated rows give repeated rows;
other columns are not read.  Positions are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches as Java finds them without deep recursion or retries: a
#: match starts only where a run begins or the last match ended, and repeated
#: groups with nothing behind them don't give characters back.
_JAVA = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character every match contains: texts without it skip the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


@dataclass(frozen=True)
class Recognizer:
    kind: str
    pattern: str
    needs: str = ""                  # literal that must occur in the text
    score: float = 0.4
    boost: float = 0.3               # for a context word near the span
    context: tuple[str, ...] = ()


#: Lengths of account codes by country, from the public IBAN registry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """Codes of each country's own length, in groups of four or unspaced; what
    follows the last group is not part of the code."""
    kinds = []
    for length, countries in IBAN_COUNTRIES.items():
        groups, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        kinds.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(kinds)})(?![A-Za-z0-9])"


#: Added kinds; ids and tokens follow their issuers' public formats.
ADDED = (
    Recognizer("iban", _iban_pattern(), score=0.8,
               context=("iban", "account", "konto", "compte", "cuenta", "bank")),
    Recognizer("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", needs="-", score=0.3,
               context=("ssn", "social security", "tax id", "national id")),
    Recognizer("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", needs="IA", score=0.7),
    Recognizer("secret", r"(?<![A-Za-z0-9])[0-9a-f]{16,64}(?![A-Za-z0-9])", score=0.2, boost=0.4,
               context=("password", "passwd", "token", "secret", "api_key", "apikey", "api key")),
)


@dataclass(frozen=True)
class PiiRules:
    threshold: float = 0.5
    window: int = 48
    added: tuple[Recognizer, ...] = field(default=ADDED)


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder by 97 of an account code (letters count 10 .. 35), its first
    four characters moved to the end."""
    flat = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP_OK = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(_IP_OK)
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m) == 1
    return F.lit(True)


def _found(kind: str, text: Column, pieces: Column, matches: Column, rules: PiiRules,
           rec: Recognizer | None) -> Column:
    """Array of (start, end, ok, score) of one kind's proposals."""
    window = rules.window
    context = "|".join(rec.context).replace(" ", r"\x20") if rec is not None else ""
    if context:                                        # whole words, or their plural
        context = rf"(?<![a-z0-9])(?:{context})s?(?![a-z0-9])"

    # behind a span, a word before "=" or ":" tells of the value that follows it
    behind = rf"{context}(?![a-z0-9_]*[\"']?\x20*[:=])"

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        ok, tail = x["ok"], F.lit("")
        if context:
            before = F.concat(acc["tail"], F.substring(x["piece"], -window, window))
            near = F.lower(F.substring(before, -window, window)).rlike(context) | F.lower(x["after"]).rlike(behind)
            ok = ok & (F.when(near, rec.score + rec.boost).otherwise(rec.score) >= rules.threshold)
            tail = F.substring(F.concat(before, x["match"]), -window, window)
        return F.struct(end.alias("at"),
                        F.when(ok, F.concat(acc["spans"], F.lit(f"{kind}:"), start.cast("string"), F.lit(":"),
                                            end.cast("string"), F.lit(",")))
                        .otherwise(acc["spans"]).alias("spans"),
                        (acc["n"] + ok.cast("long")).alias("n"), tail.alias("tail"))

    def judged(p, i):
        m = F.get(matches, i)
        ok = F.coalesce(_valid(kind, m), F.lit(False))
        after = F.lit("")
        if context:
            # at most ``window`` matches of a character or more lie in the window
            after = F.substring(F.array_join(F.zip_with(
                F.slice(pieces, i + 2, window + 1), F.slice(matches, i + 2, window + 1),
                lambda q, n: F.concat(F.substring(q, 1, window), F.coalesce(n, F.lit("")))), ""), 1, window)
        elif rec is not None:
            ok = ok & F.lit(rec.score >= rules.threshold)
        return F.struct(p.alias("piece"), m.alias("match"), ok.alias("ok"), after.alias("after"))
    pairs = F.transform(F.slice(pieces, 1, F.size(matches)), judged)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n"), F.lit("").alias("tail"))
    return F.aggregate(pairs, zero, step, lambda a: F.struct(a["spans"].alias("spans"), a["n"].alias("n")))


def find_pii(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_<kind>`` of the base kinds, ``n_added``,
    ``base_spans`` and ``spans`` (``kind:start:end`` joined by commas)."""
    recs: list[tuple[str, str, str, Recognizer | None]] = [
        (k, p, _NEEDS.get(k, ""), None) for k, p in _JAVA.items()]
    recs += [(r.kind, r.pattern, r.needs, r) for r in rules.added]
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    text = F.col("_t")
    none = F.array().cast("array<string>")
    cols, found = [], []
    for kind, pattern, needs, _ in recs:
        hit = text.contains(needs) if needs else text.rlike("[0-9]")
        cols.append(F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"_m_{kind}"))
    df = df.select("doc_id", "_t", *cols)
    cols = [F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none).alias(f"_p_{kind}")
            for kind, pattern, _, _ in recs]
    df = df.select("doc_id", "_t", *[f"_m_{k}" for k, *_ in recs], *cols)
    for kind, _, _, rec in recs:
        found.append(F.when(F.size(f"_m_{kind}") > 0, _found(kind, text, F.col(f"_p_{kind}"), F.col(f"_m_{kind}"), rules, rec))
                     .alias(f"_f_{kind}"))
    df = df.select("doc_id", *found)

    def spans(kinds):
        return F.rtrim(F.concat(*[F.coalesce(F.col(f"_f_{k}.spans"), F.lit("")) for k in kinds]), F.lit(","))
    kinds = [k for k, *_ in recs]

    def n(k):
        return F.coalesce(F.col(f"_f_{k}.n"), F.lit(0)).cast("long")
    return df.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE],
                     sum([n(k) for k in kinds if k not in BASE], F.lit(0).cast("long")).alias("n_added"),
                     spans(list(BASE)).alias("base_spans"), spans(kinds).alias("spans"))
