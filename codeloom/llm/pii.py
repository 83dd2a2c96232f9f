"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression. A span is (kind, start, end, score, base): code points, end exclusive.
Patterns run on copies of the text in which a separator that surely belongs to a match is replaced by one
private character, so that no pattern needs a repeated group and none looks twice at the same run.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, without

JOIN, SPARE = "\ue000", "\ue001"  # private characters: the mark, and what a mark already in a text becomes
CONTEXT = 40  # code points looked at on each side
BLOCK = 256   # prefix sums work in blocks of this many matches

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str                                  # texts without this are not searched
    pattern: str
    valid: Callable[[Column], Column]           # checksum and form of one match
    score: float                                # of a confirmed match
    context: str                                # words nearby that raise the score
    gain: float
    base: bool = True                           # base spans stay whatever their score
    mark: str = ""                              # separators replaced by JOIN before matching
    cut: Callable[[Column], Column] | None = None   # of a match and its group 1 (looked ahead at): the part that counts


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _compact(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _mod97(m: Column) -> Column:
    """The remainder of an account number: first four characters last, letters as 10 to 35."""
    compact = _compact(m)
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    signs = F.lit(string.digits + string.ascii_uppercase)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (
        a * F.when(c <= "9", 10).otherwise(100) + F.position(c, signs) - 1) % 97)
    return (rest == 1) & F.length(compact).between(15, 34)


#: Characters of an account number by country.
_LENGTHS = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in names.split()}


def _account(run: Column) -> Column:
    """The account number that a run of upper-case words and numbers begins with, or null.

    It ends where a word ends, at the length of its country; of a country not listed it is the longest
    part whose checksum is right.
    """
    known = F.create_map(*[F.lit(x) for pair in _LENGTHS.items() for x in pair])
    words = F.split(run, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    size = lambda p: F.length(_compact(p))
    fits = F.filter(parts, lambda p: size(p).between(15, 34) & (
        size(p) == F.coalesce(known[F.left(p, F.lit(2))], size(p))) & p.rlike("^[A-Z0-9 ]+$") & _mod97(p))
    return F.get(fits, F.size(fits) - 1)


KINDS = (
    Kind("email", "@", rf"(?:(?<![A-Za-z0-9._%+{JOIN}-])|\G)[A-Za-z0-9._%+{JOIN}-]++@"
         rf"[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++", lambda m: F.lit(True), 0.9,
         r"(?i)mail|contact|write to|kontakt|courriel|correo", 0.1,
         mark=r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda m: m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), 0.6,
         r"(?i)\bip\b|address|host|server|login|adresse|direcci", 0.3),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}", rf"[0-9][0-9{JOIN}]++",
         lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), 0.9,
         r"(?i)card|visa|master|credit|karte|carte|tarjeta", 0.1, mark=r"(?<=[0-9])[ -](?=[0-9])"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]",
         lambda m: F.length(_digits(m)).between(10, 15), 0.6,
         r"(?i)phone|call|mobile|fax|tel\b|telefon|t[ée]l[ée]phone|m[óo]vil", 0.3),
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}[A-Za-z0-9]?))", lambda m: m.isNotNull(), 0.9,
         r"(?i)iban|account|bank|konto|compte|cuenta", 0.1, base=False, cut=_account),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.4,
         r"(?i)\bssn\b|social security|tax id|taxpayer", 0.5, base=False),
)
#: An added span needs this score; context carries a weak form over it.
THRESHOLD = 0.7


def _running(df: DataFrame, sizes: Column, out: str) -> DataFrame:
    """df with `out`: what comes before each entry of sizes, summed; blocks keep the work near linear."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    df = df.withColumn("__sizes", sizes)
    df = df.withColumn("__blocks", F.when(F.size("__sizes") > 0, F.transform(
        F.sequence(F.lit(0), block(F.size("__sizes") - 1)),
        lambda b: add(F.slice("__sizes", b * BLOCK + 1, F.lit(BLOCK))))))
    return df.withColumn(out, F.transform("__sizes", lambda x, i: (
        add(F.slice("__blocks", F.lit(1), block(i)))
        + add(F.slice("__sizes", block(i) * BLOCK + 1, i % BLOCK))))).drop("__sizes", "__blocks")


def _spans_of(df: DataFrame, k: Kind) -> DataFrame:
    """df with column __<kind>: its spans in the column __text, by start."""
    guard = F.col("__text").contains("@") if k.guard == "@" else F.col("__text").rlike(k.guard)
    clean = F.when(F.col("__text").contains(JOIN), F.replace("__text", F.lit(JOIN), F.lit(SPARE))).otherwise(
        F.col("__text"))
    marked = F.regexp_replace(clean, k.mark, JOIN) if k.mark else clean
    df = df.withColumn("__marked", F.when(guard, marked))
    df = (df.withColumn("__hit", F.regexp_extract_all("__marked", F.lit(k.pattern), F.lit(0)))
          .withColumn("__hit", F.when(F.size("__hit") > 0, F.col("__hit")))
          .withColumn("__gap", F.when(F.col("__hit").isNotNull(), F.split("__marked", k.pattern, -1))))
    df = _running(df, F.transform("__hit", lambda m, i: F.length(m) + F.length(F.get("__gap", i))), "__before")
    if k.cut:  # the pattern takes no more than the start, so that each start is looked at
        ahead = F.regexp_extract_all("__marked", F.lit(k.pattern), F.lit(1))
        df = df.withColumn("__found", F.when(F.col("__hit").isNotNull(), F.zip_with(
            "__hit", ahead, lambda m, more: k.cut(F.concat(m, more)))))
    found = lambda m, i: F.get("__found", i) if k.cut else m
    after = lambda m, i: F.substr(
        F.get("__gap", i + 1), F.length(found(m, i)) - F.length(m) + 1) if k.cut else F.get("__gap", i + 1)
    near = lambda m, i: F.concat(F.right(F.get("__gap", i), F.lit(CONTEXT)), F.lit("\n"),
                                 F.left(after(m, i), F.lit(CONTEXT)))
    score = lambda m, i: F.lit(k.score) + F.when(near(m, i).rlike(k.context), k.gain).otherwise(0.0)
    start = lambda i: F.get("__before", i) + F.length(F.get("__gap", i))
    spans = F.transform("__hit", lambda m, i: F.when(k.valid(found(m, i)), F.struct(
        start(i).alias("start"), F.lit(KINDS.index(k)).alias("place"), F.lit(k.name).alias("kind"),
        (start(i) + F.length(found(m, i))).alias("end"), F.round(score(m, i), 3).alias("score"),
        F.lit(k.base).alias("base"))))
    stays = lambda s: s.isNotNull() & (s["base"] | (s["score"] >= THRESHOLD))
    return df.withColumn(f"__{k.name}", F.filter(spans, stays)).drop(
        "__marked", "__hit", "__gap", "__before", "__found")


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Every input row with `out`: its spans as an array of (start, place, kind, end, score, base), in order.

    Whole texts are searched. Base kinds (email, ip, card, phone) hold every match that passes its check;
    added kinds (iban by mod 97, national_id) need a score of THRESHOLD, which context words help to reach.
    A null or empty text has no spans. A column called like `out` is replaced; other columns pass through,
    whatever their names. Repeated rows are answered one by one.
    """
    own = without(docs, out)
    df = docs.select(F.struct(F.lit(0).alias("none"), *own).alias("__row"),
                     text_or_empty(docs[f"`{text}`"]).alias("__text"))
    for k in KINDS:
        df = _spans_of(df, k)
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,score:double,base:boolean>>")
    every = F.concat(*[F.coalesce(F.col(f"__{k.name}"), empty) for k in KINDS])
    names = [c for c in docs.columns if c.lower() != out.lower()]
    return df.select(*[F.col("__row").getField(c).alias(c) for c in names], F.sort_array(every).alias(out))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Put [KIND] where spans are; overlapping spans become one, named after the first.

    Rows without spans, null texts among them, keep their text as it is.
    """
    joined = F.aggregate(F.col(spans), F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > s["start"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
            F.get(a, F.size(a) - 1)["start"].alias("start"),
            F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"),
            F.get(a, F.size(a) - 1)["kind"].alias("kind"))))).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    cuts = docs.withColumn("__cuts", F.when(F.size(spans) > 0, joined))
    part = lambda s, i: F.concat(
        F.substr(F.col(text), F.when(i == 0, 0).otherwise(F.get("__cuts", i - 1)["end"]) + 1,
                 s["start"] - F.when(i == 0, 0).otherwise(F.get("__cuts", i - 1)["end"])),
        F.lit("["), F.upper(s["kind"]), F.lit("]"))
    tail = F.substr(F.col(text), F.get("__cuts", F.size("__cuts") - 1)["end"] + 1)
    masked = F.concat(F.array_join(F.transform("__cuts", part), ""), tail)
    order = [c for c in docs.columns]
    return (cuts.withColumn(text, F.when(F.col("__cuts").isNotNull(), masked).otherwise(F.col(text)))
            .select(*[F.col(f"`{c}`") for c in order]))
