"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans (leftmost, not overlapping within a kind), validators
confirm them (Luhn for cards, mod 97 for account numbers, number ranges for
addresses, the variety of characters for secrets), and words near a span adjust
its score.  Base kinds (email, ip, card, phone) are kept once valid; further
kinds (iban, ssn, secret) are kept from ``threshold`` on, so a bare ssn-like
number or a random-looking word without a context word is not reported.

Patterns are linear in the text: runs are taken possessively, and an attempt
starts only at a run's first character or where the last match ended, which
gives the same matches as trying every character.

Null and empty texts have no spans.  Repeated rows give repeated results;
other columns pass through, and a clash with an output name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import running_sums

#: Order of kinds among spans that start together.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
#: Length of the account numbers of each country in the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_REST = r"[0-9]{2}(?:\x20?[A-Z0-9])"
#: A number ends where its country's do, whatever follows; other letters are taken as far as they go.
_IBANS = [f"(?:{c.replace(' ', '|')}){_REST}{{{n - 4}}}" for n, c in IBAN_LENGTHS.items()] + [f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}{_REST}{{11,30}}"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(_IBANS)})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
}
#: A cheap test that a text may hold the kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "secret": "[A-Za-z0-9_-]{16}"}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|server|host",
    "card": "card|credit|visa|payment",
    "phone": r"phone|tel\b|call|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security",
    "secret": "pass|pwd|secret|token|key|credential|auth|bearer",
}
#: Score of a proposal that its validator confirms, before context; a context word adds CONTEXT_BONUS.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
CONTEXT_BONUS = 0.2
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
#: Key ids that need no context word, of published forms.
KEY_ID = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$"
#: A secret has letters and digits, and so many different characters.
VARIETY = 8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number without spaces passes the mod 97 check."""
    turned = F.concat(F.substring(value, 5, 100), F.substring(value, 1, 4))
    step = lambda s, c: F.when(F.ascii(c) >= 65, s * 100 + F.ascii(c) - 55).otherwise(s * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "secret":
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.when(mixed, F.size(F.array_distinct(F.split(F.lower(value), ""))) >= VARIETY).otherwise(F.lit(False))
    return F.lit(True)


def _positions(kind: str) -> Column:
    """Matches with code-point offsets, from the texts between them."""
    found, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
    # A match starts behind all gaps and matches before it, and its own gap.
    before = running_sums(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g)))
    told = F.zip_with(found, F.zip_with(before, gaps, lambda at, g: at + F.length(g)), lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")))
    some = F.filter(told, lambda s: s["value"].isNotNull())
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, some).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))


def find_pii(df: DataFrame, text: str = "text", threshold: float = 0.5, keep_score: bool = True) -> DataFrame:
    """df with pii array<struct<start,end,kind,value,score>>, sorted by start, then kind."""
    helpers = {f"_{p}_{k}" for p in "mgs" for k in KINDS}
    if clash := ({"pii"} | helpers) & {*df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    body = F.coalesce(F.col(text), F.lit(""))
    found = {}
    for kind in KINDS:
        maybe = body.rlike(HINTS[kind])
        found[f"_m_{kind}"] = F.when(maybe, F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0)))
        found[f"_g_{kind}"] = F.when(maybe, F.split(body, PATTERNS[kind], -1))
    out = df.withColumns(found)
    # Patterns run once; what follows sees only their matches.
    out = out.withColumns({f"_s_{kind}": _positions(kind) for kind in KINDS})

    def scored(kind: str) -> Column:
        def span(s: Column) -> Column:
            first = F.greatest(F.lit(1).cast("long"), s["start"] + 1 - CONTEXT_BEFORE).cast("int")
            near = F.substring(body, first, (s["end"] - s["start"] + CONTEXT_BEFORE + CONTEXT_AFTER).cast("int"))
            first_score = F.when(s["value"].rlike(KEY_ID), 0.9).otherwise(BASE_SCORE[kind]) if kind == "secret" else F.lit(BASE_SCORE[kind])
            score = first_score + F.when(near.rlike("(?i)" + CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), F.round(score, 2).alias("score"))

        spans = F.transform(F.filter(f"_s_{kind}", lambda s: _valid(kind, s["value"])), span)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= threshold)

    out = out.withColumn("pii", F.array_sort(F.concat(*(scored(k) for k in KINDS))))
    return out.drop(*helpers)


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """The text with each span replaced by its kind; of overlapping spans the first stands."""
    return df.withColumn(
        text,
        F.expr(f"""
        concat_ws('', flatten(array(
          aggregate({pii}, named_struct('at', 0L, 'out', cast(array() as array<string>)),
            (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, 'out',
               concat(a.out, array(substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), concat('[', upper(s.kind), ']'))))),
            a -> concat(a.out, array(substring({text}, cast(a.at + 1 as int))))))))"""),
    )


def op5_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, n_secret."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", label), ",").alias("spans"), *(count(k) for k in KINDS[len(BASE) :]))
