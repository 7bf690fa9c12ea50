"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Every pattern is one pass of the JVM's regular expressions over the whole text.  What
lies between matches gives their places (in code points) and the words near them, so a
span needs no second look at its text.  Repetitions are possessive: they can't match
otherwise, and neither the stack nor the time grows with a run of characters beyond it.

Base kinds are reported whatever their score; the kinds that the method adds are
reported from LEAST on.  Only DataFrame functions run here, all of them on the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

BASE = ("email", "ip", "card", "phone")
#: The order of kinds that start at the same place.
KINDS = (*BASE, "iban", "card_part", "phone_part", "id_number")
#: Characters on each side of a span in which context words count.
NEAR = 48
#: The score from which an added span is reported.
LEAST = 0.5
#: A span begins where no character of its first run stands before it, or where the last match ended.
FRESH = r"(?:(?<![{0}])|\G)"
#: What proposes spans. A run of fewer digits than a card has can't hold one, so it is no match at all.
PATTERNS = {
    "email": FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": FRESH.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}",
    "card": FRESH.format("0-9") + r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without these can't match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "id_number": "-"}
#: Within a run of digits that is no card as a whole, and at the start of what is no phone number as a whole.
CARD_PART = r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
PHONE_PART = r"^\+(?:1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[2-9][0-9]{9,14})(?![0-9])"
#: First digits of the card networks; lengths of account numbers by country.
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Words that speak for a kind, and against it.
FOR = {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|client|remote|adresse",
    "card": "card|credit|debit|visa|mastercard|amex|payment|cvv|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone",
    "iban": "iban|bank|account|transfer|konto|cuenta|compte|swift|bic",
    "id_number": "ssn|social security|tax id|tin|national id|passport",
}
AGAINST = {"email": "example|noreply", "ip": "version|release|section|chapter|build", "card": "order|invoice|serial|isbn|tracking|sku", "phone": "order|invoice|serial|isbn", "iban": "serial|model|part no", "id_number": "order|invoice|serial|part no|isbn"}
#: The score of a confirmed span without context, and what context adds or takes.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.8, "card_part": 0.35, "phone_part": 0.6, "id_number": 0.3}
CONTEXT = 0.3
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def once(value: Column, f) -> Column:
    """f(value), value being computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before_each(sizes: Column, block: int = 128) -> Column:
    """For each entry the sum of those before it; summed in blocks, so that long arrays take little more than linear time."""
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("each"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<array<bigint>>").alias("each"))

    def summed(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(all_, b * block + 1, block))
        within = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["each"], F.array(s["sum"])).alias("each"))))
        return F.flatten(F.aggregate(within, start, lambda s, x: F.struct((s["sum"] + x["sum"]).alias("sum"), F.concat(s["each"], F.array(F.transform(x["each"], lambda v: v + s["sum"]))).alias("each")))["each"])

    return once(sizes, summed)


def placed(matches: Column, between: Column) -> Column:
    """(match, start, before, after) of each match: between holds what lies before the first, between any two, and after the last."""
    sizes = F.transform(matches, lambda m, i: (F.char_length(m) + F.char_length(F.get(between, i))).cast("bigint"))
    return F.zip_with(
        F.transform(matches, lambda m, i: F.struct(m.alias("match"), F.get(between, i).alias("before"), F.get(between, i + 1).alias("after"))),
        before_each(sizes),
        lambda x, at: F.struct(x["match"].alias("match"), (at + F.char_length(x["before"])).alias("start"), F.right(x["before"], F.lit(NEAR)).alias("before"), F.left(x["after"], F.lit(NEAR)).alias("after")),
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def octets(text: Column) -> Column:
    """Whether all parts are at most 255."""
    return F.forall(F.split(text, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)


def is_card(text: Column) -> Column:
    return F.length(digits(text)).between(14, 19) & F.call_function("luhn_check", digits(text))


def is_phone(text: Column) -> Column:
    return F.length(digits(text)).between(10, 15)


def is_iban(text: Column) -> Column:
    """The country's length, and a remainder of 1 modulo 97."""
    plain = F.replace(text, F.lit(" "))
    length = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for c in codes.split() for x in (c, n)])
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return (F.length(plain) == F.get(F.map_values(F.map_filter(length, lambda k, v: k == F.left(plain, F.lit(2)))), F.lit(0))) & (rest == 1)


def weighed(kind: str, match: Column, before: Column, after: Column) -> Column:
    """The score of a confirmed span."""
    of = kind.removesuffix("_part")
    near = F.lower(F.concat_ws(" ", before, after))
    says = lambda words: near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
    score = F.lit(PRIOR[kind]) + F.when(says(FOR[of]), CONTEXT).otherwise(0.0) - F.when(says(AGAINST[of]), CONTEXT).otherwise(0.0)
    if of == "card":
        score = score + F.when(digits(match).rlike(ISSUER), 0.15).otherwise(0.0)
    if of == "ip":  # addresses of no one
        score = score - F.when(match.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\."), 0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def span(kind: str, match: Column, start: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(match)).alias("end"), F.lit(kind).alias("kind"), weighed(kind, match, before, after).alias("score")).cast(SPAN)


def spans_of(kind: str, found: Column, confirmed) -> Column:
    return F.transform(F.filter(found, lambda x: confirmed(x["match"])), lambda x: span(kind, x["match"], x["start"], x["before"], x["after"]))


def parts_of(kind: str, found: Column, whole, pattern: str, confirmed) -> Column:
    """Spans within matches that are none as a whole."""

    def within(x: Column) -> Column:
        inner = placed(F.regexp_extract_all(x["match"], F.lit(pattern), F.lit(0)), F.split(x["match"], pattern))
        near = lambda y: (F.right(F.concat(x["before"], y["before"]), F.lit(NEAR)), F.left(F.concat(y["after"], x["after"]), F.lit(NEAR)))
        return F.transform(F.filter(inner, lambda y: confirmed(y["match"])), lambda y: span(kind, y["match"], x["start"] + y["start"], *near(y)))

    return F.flatten(F.transform(F.filter(found, lambda x: ~whole(x["match"])), within))


def account_numbers(found: Column) -> Column:
    """Spans of account numbers; a last group that belongs to the next word is left off."""
    shorter = lambda m: F.regexp_replace(m, r"\x20[A-Z0-9]+$", "")
    best = F.transform(found, lambda x: F.struct(F.when(is_iban(x["match"]), x["match"]).when(is_iban(shorter(x["match"])), shorter(x["match"])).alias("match"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after")))
    return F.transform(F.filter(best, lambda x: x["match"].isNotNull()), lambda x: span("iban", x["match"], x["start"], x["before"], x["after"]))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans): the base spans of each row, and all that are reported, as arrays of (start, rank, end, kind, score) by start, then kind.

    A null or empty text has none; rows without a doc_id are left out; rows that repeat
    a doc_id are searched each by itself; spans of two kinds may overlap, and those that
    start together go by kind as KINDS lists them; texts of any length are searched
    whole; an empty table gives no rows; other columns are ignored.
    """
    none = F.array().cast("array<string>")
    d = documents(docs)
    for k, p in PATTERNS.items():
        all_of = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        d = d.withColumn(f"m_{k}", F.when(F.contains("text", F.lit(NEEDS[k])), all_of).otherwise(none) if k in NEEDS else all_of)
    d = d.select("doc_id", "text", *[F.struct(F.col(f"m_{k}").alias("m"), F.when(F.size(f"m_{k}") > 0, F.split("text", p)).otherwise(none).alias("s")).alias(k) for k, p in PATTERNS.items()])
    empty = F.array().cast(f"array<{SPAN}>")
    whole = {"email": lambda m: F.lit(True), "ip": octets, "card": is_card, "phone": is_phone}
    some = lambda k, f: F.when(F.size(f"{k}.m") > 0, f(placed(F.col(f"{k}.m"), F.col(f"{k}.s")))).otherwise(empty)
    base = [some(k, lambda found, k=k: spans_of(k, found, whole[k])) for k in BASE]
    added = [
        some("iban", account_numbers),
        some("id_number", lambda found: spans_of("id_number", found, lambda m: F.lit(True))),
        some("card", lambda found: parts_of("card_part", found, is_card, CARD_PART, is_card)),
        some("phone", lambda found: parts_of("phone_part", found, is_phone, PHONE_PART, is_phone)),
    ]
    d = d.select("doc_id", "text", F.array_sort(F.concat(*base)).alias("base"), F.filter(F.concat(*added), lambda s: s["score"] >= LEAST).alias("added"))
    return d.select("doc_id", "text", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, text) with each reported span of that score replaced by its kind in brackets; of spans that overlap the first stays."""
    found = personal_data(docs).withColumn("use", F.filter("spans", lambda s: s["score"] >= least))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(gap, F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")))

    last = F.aggregate("use", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    return found.select("doc_id", last.alias("text"))


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """personal_data() of the whole table documents; see there for nulls, empty and repeated rows."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))
