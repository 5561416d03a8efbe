"""Personal data by column functions alone: regex spans, checksums, context scores."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents, id_and_text

CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
CONTEXT_BONUS = 0.3
ACCEPTED = 0.6
BLOCK = 256


def part_at_most_255() -> str:
    return "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    number = digits(found)
    return F.length(number).between(14, 19) & F.call_function("luhn_check", number)


def mod_97(found: Column) -> Column:
    """The check of international account numbers: the rotated number modulo 97 is 1."""
    bare = F.regexp_replace(found, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= F.lit(65)
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, F.lit(100)).otherwise(F.lit(10)) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


class Kind(NamedTuple):
    """How spans of a kind are proposed, confirmed and scored.

    ``gate`` is a cheap test without which a text has no such span. Kinds of the
    base are kept whatever their score, others from ``ACCEPTED`` on.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    confirm: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool = True


def has(text: str) -> Callable[[Column], Column]:
    return lambda c: F.contains(c, F.lit(text))


def has_digits(c: Column) -> Column:
    return c.rlike("[0-9]")


# Runs are matched possessively and from their first character, so no text is scanned
# twice: the time is linear even in a text that is one long run.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        has("@"),
        None,
        0.7,
        "mail|contact|write to",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        has_digits,
        lambda found: found.rlike(rf"^{part_at_most_255()}(?:\.{part_at_most_255()}){{3}}$"),
        0.5,
        r"\bip\b|address|host|server|login|logged",
    ),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", has_digits, luhn, 0.7, "card|visa|master|credit|payment|paid"),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        has("+"),
        lambda found: F.length(digits(found)).between(10, 15),
        0.6,
        "phone|tel|call|mobile|fax|whatsapp",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        has_digits,
        mod_97,
        0.7,
        "iban|account|konto|compte|cuenta|bank",
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        has("-"),
        None,
        0.4,
        "ssn|social security",
        base=False,
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+.)-])(?<![0-9+.)-]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
        has_digits,
        None,
        0.4,
        "phone|tel|call|mobile|fax",
        base=False,
    ),
)


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array, appended block by block so that long arrays stay cheap."""
    empty = F.array().cast("array<bigint>")

    def step(acc: Column, v: Column) -> Column:
        total = acc["total"] + v
        grown = F.concat(acc["open"], F.array(total))
        full = F.size(acc["open"]) == BLOCK - 1
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"),
            F.when(full, empty).otherwise(grown).alias("open"),
            total.alias("total"),
        )

    start = F.struct(
        F.array().cast("array<array<bigint>>").alias("done"),
        empty.alias("open"),
        F.lit(0).cast("bigint").alias("total"),
    )
    return F.aggregate(values, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (start, order, end, kind, score, base).

    For each kind the text is cut at the pattern's matches; the lengths of what lies
    between give the places, counted in code points, end exclusive, and its edges
    the context. Matches that fail the checksum are dropped. Spans are ordered by
    start, then by kind. Null and empty texts have none; repeated rows and null
    ids give a row each. No row moves and nothing leaves the JVM.
    """
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    cuts = []
    for i, kind in enumerate(kinds):
        pattern, likely = F.lit(kind.pattern), kind.gate(F.col("text"))
        cuts.append(F.when(likely, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(nothing).alias(f"f{i}"))
        cuts.append(F.when(likely, F.split("text", kind.pattern, -1)).otherwise(nothing).alias(f"p{i}"))
    rows = rows.select("doc_id", *cuts)
    rows = rows.select("*", *[match_ends(i).alias(f"e{i}") for i in range(len(kinds))])
    spans = [kind_spans(i, kind) for i, kind in enumerate(kinds)]
    return rows.select("doc_id", F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def match_ends(i: int) -> Column:
    """Where the matches of kind ``i`` end: the sums of what lies between and the matches."""
    between = F.col(f"p{i}")
    step = lambda found, at: (F.length(F.get(between, at)) + F.length(found)).cast("bigint")
    return running_sum(F.transform(f"f{i}", step))


def kind_spans(i: int, kind: Kind) -> Column:
    """The confirmed spans of one kind with their scores."""

    def span(found: Column, at: Column) -> Column:
        end = F.get(F.col(f"e{i}"), at)
        before, after = F.get(F.col(f"p{i}"), at), F.get(F.col(f"p{i}"), at + 1)
        near = F.lower(F.concat(F.right(before, F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(after, F.lit(CONTEXT_AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            (end - F.length(found)).alias("start"),
            F.lit(i).alias("order"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            score.alias("score"),
            F.lit(kind.base).alias("base"),
            (kind.confirm(found) if kind.confirm else F.lit(True)).alias("valid"),
        )

    accepted = lambda s: s["valid"] & (s["base"] | (s["score"] >= ACCEPTED))
    names = ("start", "order", "end", "kind", "score", "base")
    plain = lambda s: F.struct(*[s[n].alias(n) for n in names])
    return F.transform(F.filter(F.transform(f"f{i}", span), accepted), plain)


def op2_pii(spark, sf_dir):
    """Counts, digest and all spans of every document."""
    found = find_pii(documents(spark, sf_dir))
    text_of = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text_of), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[of_kind(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("highest_score"),
    )
