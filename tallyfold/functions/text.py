"""Text functions: redaction and its independent leak scan, lexicon scores, names, tickers and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabularies of SURVEY I2, in the order in which they are tried.
EXCHANGES = (
    "New York Stock Exchange", "NYSE American", "NYSE Arca", "NYSE", "NASDAQ Global Select Market", "NASDAQ Global Market", "NASDAQ Capital Market", "The NASDAQ Stock Market", "NASDAQ", "Nasdaq", "Chicago Board Options Exchange", "Cboe", "BATS", "OTC Markets", "Toronto Stock Exchange",
)
AUDITORS = (
    "PricewaterhouseCoopers", "PwC", "Deloitte & Touche", "Deloitte", "Ernst & Young", "EY LLP", "KPMG", "Grant Thornton", "BDO USA", "BDO Seidman", "RSM US", "Crowe LLP", "Moss Adams", "Marcum LLP", "Computershare", "American Stock Transfer", "Equiniti", "Broadridge", "Continental Stock Transfer", "Wells Fargo Shareowner Services", "EQ Shareowner",
)
#: "West Virginia" is absent as in effect in the reference: Virginia goes first there, and "West" stays.
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "Wisconsin", "Wyoming",
)
STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Plaza|Parkway|Pkwy|Court|Ct|Circle|Cir|Square|Sq|Center|Centre|Highway|Hwy|Terrace|Place|Pl"
TITLES = (
    r"Chief\s+\w+\s+Officer|President|Chairman|Chairwoman|Chairperson|Chair|Vice\s+President|Executive\s+Vice\s+President|Senior\s+Vice\s+President|Chief\s+Executive|"
    r"Chief\s+Financial|Chief\s+Operating|CEO|CFO|COO|CTO|Treasurer|Secretary|General\s+Counsel|Controller|Director|Trustee"
)
PERSON_NAME = r"[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z'\-]+){1,2}"


def phrases(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


#: Name, pattern and replacement of each redaction step; the order is part of the meaning.
REDACTIONS = (
    ("url", r"(?i)\b(?:https?://|www\.)[^\s<>\"]+", "[ID]"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[ID]"),
    ("filename", r"(?i)\b[\w][\w.\-]{2,}\.(?:htm|html|txt|pdf|jpe?g|png|gif|xlsx?|zip)\b", "[ID]"),
    ("cik_label", r"(?i)\b(?:CIK|Central Index Key)[\s:#]*0*\d{4,10}\b", "[ID]"),
    ("file_number", r"(?i)\b(?:Commission File(?:\s+Number)?|File No\.?|IRS Employer)[\s:#]*[\w\-]+", "[ID]"),
    ("irs_number", r"\b\d{2}-\d{7}\b", "[ID]"),
    ("street", rf"(?i)\b(?:\d{{1,6}}|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)\s+(?:[A-Z][\w.'-]+\s+){{0,4}}(?:{STREETS})\b\.?", "[ADDRESS]"),
    ("phone", r"\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "[PHONE]"),
)
LATE_REDACTIONS = (
    ("signature", r"/s/\s*[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}", "/s/ [PERSON]"),
    ("honorific_name", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,2}", "[PERSON]"),
    ("name_then_title", rf"\b{PERSON_NAME}\s*,\s*(?:our\s+|the\s+)?(?:{TITLES})\b", "[PERSON], [TITLE]"),
    ("title_then_name", rf"\b(?:{TITLES})\s*,?\s+{PERSON_NAME}\b", "[TITLE] [PERSON]"),
    ("exchange", phrases(EXCHANGES), "[EXCHANGE]"),
    ("auditor", "(?i)" + phrases(AUDITORS), "[AUDITOR]"),
    ("state", phrases(STATES), "[STATE]"),
    ("dc", r"\bD\.?\s?C\.?(?=[\s,.]|$)", "[STATE]"),
    ("city_state", rf"\b[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){{0,2}},\s*(?:\[STATE\]|(?:{STATE_CODES})\b\.?)", "[ADDRESS], [STATE]"),
    ("quarter", r"(?i)\b(?:Q[1-4]|first|second|third|fourth)\s+quarter\s+(?:of\s+)?\d{4}\b", "the relevant quarter"),
    ("fiscal_year", r"(?i)\b(?:fiscal|calendar)\s+(?:year\s+)?\d{4}\b", "the relevant fiscal year"),
    ("date_long", rf"(?i)\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", "[DATE]"),
    ("date_dmy", rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\.?,?\s+\d{{4}}\b", "[DATE]"),
    ("date_month_year", rf"(?i)\b(?:{MONTHS})\.?\s+\d{{4}}\b", "[PERIOD]"),
    ("date_numeric", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DATE]"),
    ("date_iso", r"\b\d{4}-\d{2}-\d{2}\b", "[DATE]"),
    ("zip", r"\b\d{5}(?:-\d{4})?\b", "[ID]"),
    ("bare_year", r"\b(?:19[5-9]\d|20[0-4]\d)\b", "[PERIOD]"),
)
#: What a text must hold for a step to find anything, in signs that are looked for faster; other steps are always tried.
DIGIT = r"\p{Nd}"
NEEDS = {
    "url": r"://|[wW]{3}\.", "email": "@", "filename": r"\.[hHtTpPjJgGxXzZ]", "signature": "/s/",
    **dict.fromkeys(("cik_label", "irs_number", "phone", "quarter", "fiscal_year", "date_long", "date_dmy", "date_month_year", "date_numeric", "date_iso", "zip", "bare_year"), DIGIT),
}
RUN = r"(\[(?:COMPANY|PERSON|DATE|ADDRESS|ID)\])[\s,]*(?:\[(?:COMPANY|PERSON|DATE|ADDRESS|ID)\][\s,]*)+"
#: The label of each leak scan and the step whose pattern it takes.
SCANS = (("date", "date_long"), ("date", "date_dmy"), ("date", "date_numeric"), ("date", "date_iso"), ("year", "bare_year"), ("email", "email"), ("url", "url"), ("city_state", "city_state"), ("filename", "filename"), ("street", "street"))
NAME_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "plc", "lp", "llp", "llc", "holding", "holdings", "group", "the", "and", "of", "trust", "partners", "partnership", "sa", "nv", "ag", "class", "com", "new", "international", "industries", "enterprises",
)
TOO_GENERIC = (
    "general", "american", "national", "united", "first", "global", "pacific", "atlantic", "standard", "universal", "central", "southern", "northern", "eastern", "western", "public", "service", "services", "systems", "technologies", "technology", "products", "resources", "energy", "financial", "capital", "bank", "health", "medical", "stores", "motors", "electric", "air", "states", "state", "materials", "scientific", "communications", "management", "properties", "realty",
)
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "lp", "plc", "holdings", "group", "trust", "the")
NOT_TICKERS = ("NYSE", "NASDAQ", "AMEX", "OTC", "NONE", "N/A", "NA", "NULL")


def name_variants(name: Column) -> Column:
    """Surface forms of a name, longest first: with all but letters, digits, "_", "&", "/" and "-" as blanks, then without
    company suffixes, its leading two words, and its first word if that has four letters and is no generic one."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\p{L}\p{N}_\s&/-]", " "), r"(?U)^\s+|\s+\z", "")
    words = F.filter(F.split(clean, r"(?U)\s+"), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, "^&+|&+$", "")).isin(*NAME_SUFFIXES))
    head = F.when((F.size(words) > 0) & (F.length(F.get(words, F.lit(0))) >= 4) & ~F.lower(F.get(words, F.lit(0))).isin(*TOO_GENERIC), F.get(words, F.lit(0)))
    bigram = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))
    return longest_first(F.array_compact(F.array(clean, F.array_join(words, " "), bigram, head)))


def longest_first(variants: Column) -> Column:
    """Distinct variants of three characters or more."""
    return F.array_sort(F.array_distinct(F.filter(variants, lambda v: F.length(v) >= 3)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def redaction(text: Column, variants: Column | None = None, ticker: Column | None = None, cik: Column | None = None) -> Column:
    """Struct of text, redacted, and counts, a map from step to the number of its replacements for the steps that made any.

    A fold: each step counts in, and replaces in, what the steps before it left, so nothing counts twice. A list of one binds
    a step's result, or every step would compute all before it again and again. A step without a match, or whose NEEDS are not
    there, leaves the state as it is; no step writes a digit, so that texts without one skip those that need it."""
    empty = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.expr("cast(array() as array<struct<key:string,value:int>>)").alias("counts"))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def replaced(s: Column, key: str, pattern: Column, placeholder: str) -> Column:
        done = lambda n: F.when(n > 0, F.struct(F.regexp_replace(s["text"], pattern, F.lit(placeholder)).alias("text"), F.concat(s["counts"], F.array(F.struct(F.lit(key).alias("key"), n.alias("value")))).alias("counts"))).otherwise(s)
        return bound(F.regexp_count(s["text"], pattern), done)

    def then(state: Column, key: str, pattern: Column, placeholder: str, when: Column | None = None) -> Column:
        def step(s: Column) -> Column:
            needs = NEEDS.get(key) if when is None else None
            may = F.regexp_like(s["text"], F.lit(needs)) if needs else when
            done = replaced(s, key, pattern, placeholder)
            return done if may is None else F.when(may, done).otherwise(s)

        return bound(state, step)

    def steps(state: Column, listed) -> Column:
        for key, pattern, placeholder in listed:
            state = then(state, key, F.lit("(?U)" + pattern), placeholder)
        return state

    quoted = lambda before, value, after=r"\b": F.concat(F.lit(f"(?U){before}\\Q"), value, F.lit("\\E" + after))
    out = steps(empty, REDACTIONS)
    if variants is not None:
        named = lambda s, v: replaced(s, "company_name", quoted(r"(?i)\b", v), "[COMPANY]")
        out = F.aggregate(F.coalesce(variants, F.expr("cast(array() as array<string>)")), out, named)
    if ticker is not None:
        given = F.coalesce(F.length(ticker) >= 1, F.lit(False))
        out = then(out, "ticker_with_exchange", quoted(r"\b(?:NYSE|NASDAQ|Nasdaq|AMEX)\s*:\s*", ticker), "[TICKER]", given)
        out = then(out, "ticker", quoted(r"\b", ticker), "[TICKER]", given)
    if cik is not None:
        out = then(out, "cik_number", F.concat(F.lit(r"(?U)\b0*"), cik.cast("string"), F.lit(r"\b")), "[ID]", cik.isNotNull())
    first = next(i for i, step in enumerate(LATE_REDACTIONS) if NEEDS.get(step[0]) == DIGIT)
    out = steps(out, LATE_REDACTIONS[:first])
    out = bound(out, lambda s: F.when(F.regexp_like(s["text"], F.lit(DIGIT)), steps(s, LATE_REDACTIONS[first:])).otherwise(s))  # all of these need one

    def closed(s: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["text"], RUN, "$1 "), r"[ \t]{2,}", " "), r"(?U)^\s+|\s+\z", "")
        keys = F.array_distinct(F.transform(s["counts"], lambda c: c["key"]))
        total = lambda k: F.aggregate(F.filter(s["counts"], lambda c: c["key"] == k), F.lit(0), lambda n, c: n + c["value"])
        return F.struct(t.alias("text"), F.map_from_arrays(keys, F.transform(keys, total)).alias("counts"))

    return F.get(F.transform(F.array(out), closed), F.lit(0))


def redact(text: Column, variants: Column | None = None, ticker: Column | None = None, cik: Column | None = None) -> Column:
    return redaction(text, variants, ticker, cik)["text"]


def find_leaks(text: Column, variants: Column | None = None, ticker: Column | None = None, cik: Column | None = None) -> Column:
    """SURVEY I5: sorted distinct labels 'kind:first match' of every scan of the reference over redacted text."""
    patterns = {n: "(?U)" + p for n, p, _ in (*REDACTIONS, *LATE_REDACTIONS)}
    may = lambda n: F.regexp_like(text, F.lit(NEEDS[n])) & F.regexp_like(text, F.lit(patterns[n])) if n in NEEDS else F.regexp_like(text, F.lit(patterns[n]))
    found = [F.when(may(n), F.concat(F.lit(f"{k}:"), F.substring(F.regexp_extract(text, patterns[n], 0), 1, 40))) for k, n in SCANS]
    if ticker is not None:
        found.append(F.when((F.length(ticker) >= 1) & F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), ticker, F.lit(r"\E\b"))), F.concat(F.lit("ticker:"), ticker)))
    if cik is not None:
        found.append(F.when(F.regexp_like(text, F.concat(F.lit(r"(?U)\b0*"), cik.cast("string"), F.lit(r"\b"))), F.concat(F.lit("cik:"), cik.cast("string"))))
    out = F.array_compact(F.array(*found))
    if variants is not None:
        met = F.filter(variants, lambda v: F.regexp_like(text, F.concat(F.lit(r"(?iU)\b\Q"), v, F.lit(r"\E\b"))))
        out = F.concat(out, F.transform(met, lambda v: F.concat(F.lit("company_name:"), v)))
    return F.array_sort(F.array_distinct(out))


def scoring_text(text: Column, most: int = 12_000) -> Column:
    """The first `most` characters, cut at the last blank if that lies in the last tenth."""
    head = F.substring(text, 1, most)
    blank = most - F.instr(F.reverse(head), " ") + 1  # where the last blank is
    cut = F.when((F.instr(head, " ") > 0) & (blank > 0.9 * most), F.rtrim(F.substring(text, F.lit(1), blank - 1))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def lexicon_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[A-Z]+\]", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"([A-Za-z]+)"), F.lit(1)), F.upper)


def lexicon_score(tokens: Column, positive: list[str], negative: list[str]) -> Column:
    """Struct of n_words, n_positive, n_negative and score = (positive - negative) / words, 0 without words."""
    pos = F.size(F.filter(tokens, lambda t: t.isin(*positive)))
    neg = F.size(F.filter(tokens, lambda t: t.isin(*negative)))
    n = F.size(tokens)
    return F.struct(n.alias("n_words"), pos.alias("n_positive"), neg.alias("n_negative"), F.when(n > 0, (pos - neg) / n).otherwise(0.0).alias("score"))


def score_to_probability(score: Column, scale: float = 0.02) -> Column:
    return 0.5 + 0.5 * F.least(F.abs(score) / scale, F.lit(1.0))


#: Words of a company's form, which say nothing about who it is.
NAME_NOISE = r"\b(?:INC|CORP|CORPORATION|COMPANY|CO|LTD|LIMITED|PLC|LP|LLC|HOLDINGS?|GROUP|INTERNATIONAL|THE|NEW|CLASS\s+[A-C]|COM|SA|NV|AG)\b"


def normalise_company(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), NAME_NOISE, " "), "[^A-Z0-9]", "")


def normalise_ticker(raw: Column) -> Column:
    return F.replace(F.upper(F.trim(F.regexp_replace(raw, r"[​‌‍﻿]", ""))), F.lit("."), F.lit("-"))


#: Exchange codes that stand beside a symbol, and words for no symbol.
EXCHANGE_CODES = ("NYSE", "NASDAQ", "NASD", "OTCBB", "OTC", "OTCMKTS", "OTCQB", "OTCQX", "TSX", "TSXV", "AMEX", "ARCA", "BATS", "PINK", "OB", "NYSEAMERICAN", "NYSEMKT", "CBOE", "NYSEARCA")
NO_SYMBOL = ("NA", "NONE", "N", "A", "NULL", "TBD")


def clean_ticker(raw: Column) -> Column:
    """The first token of a free-text symbol field that looks like a symbol: a letter and up to seven characters in all."""
    parts = F.transform(F.split(F.upper(F.coalesce(raw, F.lit(""))), r"[^A-Z0-9.\-]+"), lambda p: F.regexp_replace(p, r"^[.\-]+|[.\-]+$", ""))
    return F.get(F.filter(parts, lambda p: p.rlike(r"^[A-Z][A-Z0-9.\-]{0,6}$") & ~p.isin(*EXCHANGE_CODES, *NO_SYMBOL)), F.lit(0))


#: Item codes of the buckets and groups, first match first.
HIGH_IMPACT, EARNINGS = ("1.03", "2.06", "4.02", "5.02"), "2.02"
ITEM_GROUPS = (("earnings", ("2.02",)), ("management", ("5.02",)), ("agreement", ("1.01", "1.02")))


def code_set(codes: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_earnings(codes: Column) -> Column:
    return F.array_contains(code_set(codes), EARNINGS)


def bucket_for(codes: Column) -> Column:
    any_of = F.arrays_overlap(code_set(codes), F.array(*[F.lit(c) for c in HIGH_IMPACT]))
    return F.when(any_of, "high-impact").when(is_earnings(codes), "earnings").otherwise("routine")


def item_group(codes: Column) -> Column:
    out = F.lit("other")
    for name, wanted in reversed(ITEM_GROUPS):
        out = F.when(F.arrays_overlap(code_set(codes), F.array(*[F.lit(c) for c in wanted])), name).otherwise(out)
    return out


#: Phrases of an item's description and its code; the first phrase that a line has names its code.
ITEM_PHRASES = (
    ("results of operations", "2.02"), ("departure of directors", "5.02"), ("election of directors", "5.02"), ("appointment of certain officers", "5.02"),
    ("entry into a material definitive agreement", "1.01"), ("termination of a material definitive agreement", "1.02"), ("bankruptcy or receivership", "1.03"),
    ("completion of acquisition", "2.01"), ("creation of a direct financial obligation", "2.03"), ("triggering events", "2.04"), ("costs associated with exit", "2.05"),
    ("material impairments", "2.06"), ("notice of delisting", "3.01"), ("unregistered sales", "3.02"), ("material modification to rights", "3.03"),
    ("changes in registrant", "4.01"), ("non-reliance", "4.02"), ("changes in control", "5.01"), ("amendments to articles", "5.03"),
    ("temporary suspension of trading", "5.04"), ("amendment to registrant", "5.05"), ("submission of matters to a vote", "5.07"),
    ("shareholder director nominations", "5.08"), ("regulation fd", "7.01"), ("financial statements and exhibits", "9.01"), ("other events", "8.01"),
)


def item_codes(descriptions: Column) -> Column:
    """Sorted distinct codes of an array of spelled-out descriptions; what no phrase fits has none."""

    def code(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, number in reversed(ITEM_PHRASES):
            out = F.when(F.contains(F.lower(line), F.lit(phrase)), number).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(descriptions, code))))


#: Words of company names that many companies share.
SHARED_NAME_WORDS = (
    "INC CORP CORPORATION COMPANY LTD LIMITED PLC LLC HOLDING HOLDINGS GROUP THE AND TRUST INTERNATIONAL NEW AMERICAN NATIONAL UNITED GENERAL FIRST GLOBAL SERVICES SERVICE "
    "SYSTEMS TECHNOLOGIES TECHNOLOGY ENERGY FINANCIAL CAPITAL BANK INDUSTRIES ENTERPRISES RESOURCES PRODUCTS PARTNERS UNKNOWN"
).split()


def name_words(name: Column) -> Column:
    """Words of three characters or more that set a company apart."""
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*SHARED_NAME_WORDS)))


def looks_like_markup(name: Column, body: Column) -> Column:
    return F.contains(F.substring(body, 1, 2000), F.lit("<")) & F.lower(name).rlike(r"\.html?$")


def anonymized_or_raise(redacted: Column, version: Column, wanted: str) -> Column:
    """The text, where its version is the wanted one and the second scan finds nothing; other rows end the job."""
    found = find_leaks(redacted)
    return F.when(~version.eqNullSafe(F.lit(wanted)), F.raise_error(F.concat(F.lit("text of version "), F.coalesce(version, F.lit("none"))))).when(F.size(found) > 0, F.raise_error(F.concat(F.lit("leaks: "), F.array_join(found, ", ")))).otherwise(redacted)


def rendered(template: str, **fields: Column) -> Column:
    """A template with {name} places filled from columns."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def p_value(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def primary_item(codes: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("NA"))


def item_list(codes: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(codes, ","), lambda x: F.trim(x)), lambda x: x != ""))), ",")


def distinctive_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda w: (F.length(w) >= 3) & ~w.isin(*SUFFIXES)))


def parse_answer(raw: Column) -> Column:
    """Struct (direction, probability, rationale) of the first JSON object in an answer, null if any field breaks its rule."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", "")
    start = F.instr(bare, "{")
    obj = F.when(start > 0, F.from_json(F.substring(bare, start, F.length(bare)), "direction string, probability double, rationale string"))
    good = obj["direction"].isin("up", "down") & obj["probability"].between(0.5, 1.0) & (F.length(obj["rationale"]) > 0)
    return F.when(F.coalesce(good, F.lit(False)), obj)
