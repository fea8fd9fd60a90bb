"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move their score.

Only DataFrame functions. A pattern's matches come from regexp_extract_all, what lies between them from split on the same
pattern; the running sum of both gives offsets in code points. The patterns are the contract's languages written with
possessive groups and a look-behind, so that no text makes the matcher recurse or start again inside a run.

Kinds: email, ip, card and phone are always kept once confirmed (their score is informative); iban (mod-97) is kept when
confirmed; ssn, secret (32 to 64 hex digits, eight of them different) and short_card (13 to 15 digits passing Luhn) are
kept only when a context word lifts their score to `least`. Defined cases: null text is empty; no match gives counts of 0 and empty spans; rows are never merged, so repeated
rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Fixed values. kind: (pattern, what a text must contain for the pattern to be tried, context words, score before context).
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", "mail|contact|write|kontakt|correo|courriel", 0.8),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){2}+\.[0-9]++", ".", "ip|host|server|address|login", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "card|visa|master|amex|credit|karte|tarjeta|carte", 0.7),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax|ruf", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None, "iban|bank|konto|account|cuenta|compte", 0.7),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social|security", 0.3),
    "secret": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![A-Za-z0-9])", None, "token|secret|key|password|passwd|auth", 0.3),
    "short_card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![0-9])", None, "card|visa|master|amex|credit|karte|tarjeta|carte", 0.3),
}
BASE = ("email", "ip", "card", "phone")
#: Code points before a span that are searched for context words, and what one adds to the score.
CONTEXT, LIFT = 40, 0.3
#: Matches of one kind that are folded together.
CHUNK = 256


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """number: digits only. Every second digit from the right is doubled, and the sum of all digits ends in 0."""
    from_right = F.split(F.reverse(number), "")
    doubled = F.transform(from_right, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """An IBAN without blanks: its first four characters go to the end, letters become 10 to 35, and the rest by 97 is 1."""
    moved = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c == "", F.lit(None).cast("int")).when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def confirmed(kind: str, m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return ~F.exists(F.split(m, r"\."), lambda p: F.when(F.length(bare(p)) > 3, True).otherwise(F.concat(F.lit("0"), bare(p)).cast("int") > 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(d)).otherwise(False)
    if kind == "short_card":
        return luhn(d)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(m, ""))) >= 8
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def bound(x: Column, use) -> Column:
    """use(x) with x computed once: what a lambda refers to from outside it would be computed again for each element."""
    return F.element_at(F.transform(F.array(x), use), 1)


def proposals(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score, found) of the confirmed matches of one kind.

    Matches are folded in chunks of CHUNK: an array that grows by one is copied each time, which in one fold would take
    time by the square of a text's matches. A chunk counts from its own beginning, and a fold over chunks places them."""
    pattern, needs, words, base = KINDS[kind]
    shape = "array<struct<kind:string,start:int,end:int,score:double,found:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda m, b: F.struct(F.coalesce(b, F.lit("")).alias("b"), m.alias("m"))), lambda p: p["m"].isNotNull())

    def placed(a: Column, p: Column) -> Column:
        """The fold of a chunk: at (code points so far), before (the last CONTEXT of them) and out."""
        start = a["at"] + F.length(p["b"])
        context = F.lower(F.right(F.concat(a["before"], p["b"]), F.lit(CONTEXT)))
        score = F.lit(base) + F.when(context.rlike(words), LIFT).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["m"])).alias("end"), score.alias("score"), p["m"].alias("found"))
        return F.struct(
            (start + F.length(p["m"])).alias("at"),
            F.right(F.concat(a["before"], p["b"], p["m"]), F.lit(CONTEXT)).alias("before"),
            F.when(confirmed(kind, p["m"]), F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"),
        )

    def chunk(every: Column, k: Column) -> Column:
        # CONTEXT matches, of one character at least each, reach back far enough
        first = k * CHUNK + 1
        earlier = F.slice(every, F.greatest(F.lit(1), first - CONTEXT), F.least(F.lit(CONTEXT), first - 1))
        before = F.right(F.array_join(F.transform(earlier, lambda p: F.concat(p["b"], p["m"])), ""), F.lit(CONTEXT))
        zero = F.struct(F.lit(0).alias("at"), before.alias("before"), F.array().cast(shape).alias("out"))
        return F.aggregate(F.slice(every, first, F.lit(CHUNK)), zero, placed, lambda a: F.struct(a["at"].alias("size"), a["out"].alias("out")))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["score"].alias("score"), s["found"].alias("found")))

    def joined(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.array_append(a, F.element_at(a, -1) + c["size"]))
        return F.flatten(F.filter(F.zip_with(chunks, starts, lambda c, at: moved(c["out"], at)), lambda x: x.isNotNull()))

    numbers = lambda every: F.sequence(F.lit(0), ((F.size(every) - 1) / CHUNK).cast("int"))
    whole = bound(pairs, lambda every: F.when(F.size(every) == 0, F.array().cast(shape)).otherwise(bound(F.transform(numbers(every), lambda k: chunk(every, k)), joined)))
    tried = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(tried, whole).otherwise(F.array().cast(shape))


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, text and spans: array of (kind, start, end, score, found), by kind as listed in KINDS, then start."""
    d = id_and_text(docs)
    d = d.select("doc_id", "text", *[proposals(F.col("text"), k).alias(f"_{k}") for k in KINDS])
    every = [F.col(f"_{k}") if k in BASE else F.filter(f"_{k}", lambda s: s["score"] >= least) for k in KINDS]
    return d.select("doc_id", "text", F.concat(*every).alias("spans"))


def pii_report(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The contract's digest: counts and SHA-256 of the base spans, and all spans as kind:start:end."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs, least).select("doc_id", *[count(k) for k in BASE], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
