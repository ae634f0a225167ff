"""Personal data: base patterns, and further spans by weak supervision, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) come from fixed patterns with checks. Further candidates come from wide forms that
let decoys in. Labelers vote on each candidate, for or against: a stricter form of its kind, gazetteers (field names to
its left; given names, places), the characters around it, its variety of characters, its check digits (Luhn, or the
remainder by 97 of an IBAN), and its prefix (issuers of cards, countries of IBANs, area codes). Votes are counted by
pattern (at most 3^6 rows a kind); expectation-maximisation estimates each labeler's reliability, with a weak prior
that it is right more often than not; a logistic span classifier is trained on the posteriors, by feature pattern (a
bounded table too), and decides as a SQL expression. Base spans always stay; an added span overlaps none of them.

Null or empty texts have no spans; a null doc_id and repeated rows are judged row by row; further columns are ignored
by `report` and kept by `mask`.

Forms bound what their kind bounds: a house number has five digits at most, a name's word 31 letters, an IBAN 34
characters, a card number 19 digits; labelers read 30 characters of context. Addresses of mail have no bound.

Patterns use classes with possessive or plain repetition only where they repeat without bound, so that Java's matcher
does not recurse on long runs.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, unused

BASE = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = r"[0-9][0-9\x20-]*[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# fixed values: words that name a field of personal data
GAZETTEER = ("account", "address", "call", "card", "contact", "email", "fax", "iban", "key", "mail", "mobile", "name", "passport", "passwd", "password", "phone", "secret", "ssn", "tel", "token")
# fixed values: common given names, and cities
NAMES = ("Anna", "Carlos", "Carmen", "Claire", "David", "Emma", "Hans", "Jean", "John", "José", "Juan", "Laura", "Luis", "Marie", "Maria", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Thomas", "William")
PLACES = ("Barcelona", "Berlin", "Boston", "Chicago", "Hamburg", "London", "Lyon", "Madrid", "Marseille", "München", "New York", "Paris", "Sevilla", "Valencia", "Wien", "Zürich")
# fixed values: honorifics, street words
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Señor", "Señora")
STREETS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard")
# fixed values: countries that issue IBANs
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")

WORD = r"\p{Lu}\p{L}{1,30}"
FORMS = {
    "address": (rf"(?<![0-9])[0-9]{{1,5}}\x20(?:{WORD}\x20){{1,3}}(?:{'|'.join(STREETS)})", " OR ".join(f"contains(text, ' {w}')" for w in STREETS)),
    "credential": (r"(?:password|passwd|token|secret|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_-]{8,}+\"?", "contains(text, '=') OR contains(text, ':')"),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Z0-9])", "true"),
    "local_phone": (r"(?<![0-9])\(?[0-9]{3}\)?[-.\x20][0-9]{2,4}[-.\x20][0-9]{4}(?![0-9])", "true"),
    "masked_email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?{LABEL}++\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{{2,}}+", "contains(text, '(at)') OR contains(text, '[at]') OR contains(text, '(AT)') OR contains(text, '[AT]')"),
    "number": (r"(?<![0-9])[0-9]{13,19}(?![0-9])", "true"),
    "person": (rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.?\x20{WORD}(?:\x20{WORD})?", " OR ".join(f"contains(text, '{w}')" for w in TITLES)),
}
STRICT = {
    "address": r"^[1-9][0-9]{0,3}\x20",
    "credential": r"[=:]\x20?\"?(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}",
    "iban": r"^[A-Z]{2}[0-9]{13,}",
    "local_phone": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([-.\x20]))[0-9]{3}[-.\x20][0-9]{4}$",
    "masked_email": r"(?i)(?:com|de|edu|es|fr|net|org|uk)$",
    "person": rf"\x20{WORD}\x20{WORD}$",
}
PREFIX = {
    "iban": f"^(?:{'|'.join(IBAN_COUNTRIES)})",
    "local_phone": r"^\(?[2-9]",
    "number": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
}
LABELERS = ("form", "gazetteer", "around", "variety", "check", "prefix")
CONTEXT = 30


def spans(text: Column, pattern: str) -> Column:
    """Matches of pattern, leftmost and not overlapping, as structs (s, e, m): code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def add(so_far: Column, i: Column) -> Column:
        start = so_far["at"] + F.length(gaps[i])
        end = start + F.length(found[i])
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(F.struct(start.alias("s"), end.alias("e"), found[i].alias("m")))).alias("out"))

    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda x: x["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def iban_ok(m: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    chars = F.split(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), add) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds arrays email, ip, card and phone of (s, e, m)."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    text = F.col("text")
    long_run = text.rlike(r"[0-9][0-9\x20-]{11,}[0-9]")
    # separators next to another end a run; each becomes one other character, so places stay
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "_")
    card_ok = lambda x: F.length(_digits(x["m"])).between(13, 19) & F.when(F.length(_digits(x["m"])).between(13, 19), luhn(_digits(x["m"]))).otherwise(False)
    return (
        docs.withColumn("email", F.when(text.contains("@"), spans(text, EMAIL)).otherwise(none))
        .withColumn("ip", F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))).otherwise(none))
        .withColumn("card", F.when(long_run, F.filter(spans(single, RUN), card_ok)).otherwise(none))
        .withColumn("phone", F.when(text.contains("+"), F.filter(spans(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))).otherwise(none))
    )


def _candidate(kind: str, x: Column) -> Column:
    """A candidate's place, its votes (1 for, 0 against, null abstains) and the bucket of its length."""
    text, m = F.col("text"), x["m"]
    left = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    before, after = F.substring(text, x["s"], F.when(x["s"] > 0, 1).otherwise(0)), F.substring(text, x["e"] + 1, F.lit(1))
    distinct = F.size(F.array_distinct(F.split(m, "")))
    names = {"person": NAMES, "address": PLACES}.get(kind, ())
    listed = F.lower(F.concat(left, F.when(F.lit(kind == "credential"), m).otherwise(""))).rlike(r"(?<!\p{L})(?:" + "|".join(GAZETTEER) + r")(?!\p{L})")
    if names:
        near = F.concat(m, F.substring(text, x["e"] + 1, F.lit(CONTEXT)))
        listed = listed | near.rlike(rf"(?<!\p{{L}})(?:{'|'.join(names)})(?!\p{{L}})")
    check = {"number": luhn, "iban": iban_ok}.get(kind)
    votes = {
        "form": m.rlike(STRICT[kind]).cast("int") if kind in STRICT else F.lit(None),
        "gazetteer": listed.cast("int"),
        "around": F.when(before.rlike(r"[\p{L}0-9._/@-]") | after.rlike(r"[\p{L}0-9_/@-]"), 0).when((before == "") | before.rlike(r"[\n\":(<\[]"), 1),
        "variety": F.when(distinct <= 3, 0).when(distinct >= 8, 1),
        "check": check(m).cast("int") if check else F.lit(None),
        "prefix": m.rlike(PREFIX[kind]).cast("int") if kind in PREFIX else F.lit(None),
    }
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[v.cast("int").alias(k) for k, v in votes.items()], F.least(F.floor(F.length(m) / 10), F.lit(3)).cast("int").alias("size"))


def _candidates(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: _candidate(kind, x))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base arrays, and candidates that overlap no base span; null text counts as empty."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = base_spans(text)
    every = F.concat(*BASE)
    clear = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    rows = rows.withColumn("base", every)
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    parts = []
    for kind, (pattern, quick) in FORMS.items():
        free = F.filter(F.when(F.expr(quick), spans(F.col("text"), pattern)).otherwise(none), clear)
        parts.append(_candidates(kind, free))
    plain = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in BASE]
    return rows.select("doc_id", *plain, F.concat(*parts).alias("candidates"))


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """Two-class expectation-maximisation over counted vote patterns; posteriors, and P(vote 1 | class) by labeler.

    It starts from the share of votes for; each rate has a prior of four votes, three of them right.
    """
    post = []
    for votes, _ in patterns:
        cast = [v for v in votes if v is not None]
        post.append((sum(cast) + 1) / (len(cast) + 2))
    rates: list[dict] = []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        rates = []
        for j in range(len(patterns[0][0]) if patterns else 0):
            yes, every = {0: 1.0, 1: 3.0}, {0: 4.0, 1: 4.0}
            for p, (votes, n) in zip(post, patterns):
                if votes[j] is not None:
                    for c, w in ((1, p), (0, 1 - p)):
                        yes[c] += w * n * votes[j]
                        every[c] += w * n
            rates.append({c: yes[c] / every[c] for c in (0, 1)})
        post = []
        for votes, _ in patterns:
            odds = log(prior / (1 - prior))
            for r, v in zip(rates, votes):
                if v is not None:
                    odds += log(r[1] / r[0]) if v else log((1 - r[1]) / (1 - r[0]))
            post.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
    return post, rates


def _features(kind: str, votes: tuple, size: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", *(f"{k}={v}" for k, v in zip(LABELERS, votes) if v is not None)]


def fit_spans(counted: list[tuple[str, tuple, int, int]], rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of the logistic span classifier, from (kind, votes, size, count) and the labelers' posteriors."""
    by_votes: dict[tuple, int] = {}
    for _, votes, _, n in counted:
        by_votes[votes] = by_votes.get(votes, 0) + n
    post, _ = reliabilities(list(by_votes.items()))
    target = dict(zip(by_votes, post))
    rows = [(_features(k, v, s), target[v], n) for k, v, s, n in counted]
    total = sum(n for *_, n in rows) or 1
    weights = {f: 0.0 for fs, *_ in rows for f in fs}
    for _ in range(rounds):
        slope = {f: -ridge * w for f, w in weights.items()}
        for fs, y, n in rows:
            p = 1 / (1 + exp(-sum(weights[f] for f in fs)))
            for f in fs:
                slope[f] += (y - p) * n / total
        for f, g in slope.items():
            weights[f] += rate * g
    return weights


def _score(weights: dict[str, float], x: Column) -> Column:
    terms = [F.lit(weights.get("bias", -1.0))]
    for f, w in weights.items():
        name, _, value = f.partition("=")
        if value:
            terms.append(F.when(x[name] == F.lit(value if name == "kind" else int(value)), w).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms)


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base arrays, and added: candidates that the span classifier accepts. One row per row of docs."""
    found = settle(find_spans(docs), "pii-found")
    of = ["kind", *LABELERS, "size"]
    counted = found.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in of]).agg(F.count("*").alias("n")).collect()
    counted = sorted(((r.kind, tuple(r[k] for k in LABELERS), r.size, r.n) for r in counted), key=str)
    weights = fit_spans(counted)
    cut = log(threshold / (1 - threshold))
    added = F.filter("candidates", lambda x: _score(weights, x) >= cut) if weights else F.filter("candidates", lambda x: F.lit(False))
    return found.withColumn("added", F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).drop("candidates")


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(",", F.concat(*parts))


def report(docs: DataFrame) -> DataFrame:
    rows = detect(docs)
    name = lambda k: F.transform(k, lambda x: F.format_string(f"{k}:%d:%d", x["s"], x["e"]))
    base = list(map(name, BASE))
    ordered = F.array_sort("added", lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(a["s"] - b["s"]))
    extra = F.transform(ordered, lambda x: F.format_string("%s:%d:%d", x["kind"], x["s"], x["e"]))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined([*base, extra]).alias("spans"), (F.size("added") + sum(F.size(k) for k in BASE)).cast("long").alias("n_spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span (overlapping ones together) replaced by a bracketed kind, and n_chars, if there, kept right.

    Spans are joined back by doc_id and a digest of the text, so that rows sharing a doc_id keep their own.
    """
    at, spanned = unused(docs, "_at", "_spans")
    name = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("kind")))
    marked = docs.select(F.struct("doc_id", F.xxhash64("text")).alias("doc_id"), "text")
    spans_ = detect(marked).select(F.col("doc_id").alias(at), F.array_sort(F.concat(*map(name, BASE), F.transform("added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))).alias(spanned))
    spans_ = spans_.where(F.size(spanned) > 0).dropDuplicates([at])

    def add(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.when(fresh, F.concat(piece, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")).alias("out"))

    walked = F.aggregate(spanned, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    joined = docs.withColumn(at, F.struct("doc_id", F.xxhash64("text"))).join(spans_, at, "left")
    text = F.when(F.col(spanned).isNotNull(), walked).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spanned).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
