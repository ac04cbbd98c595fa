"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame operations only; one pass over the texts and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.spans import before_each, count_of, cut, digest, in_order, listed, match_spans, pieces

# Patterns of the base kinds, written so that a search is linear: a match starts at
# the start of a run of its characters, or where the last match ended, and repeats
# give nothing back. The matches are those of the plain patterns.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_NO_SSN = r"^(?:000|666|9)|-00-|-0000$"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

BASE_KINDS = ("email", "ip", "card", "phone")
# Score of a confirmed match, and words that raise it when they stand before it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"e-?mail|contact", "ip": r"\bip\b|address|host", "card": r"card|visa|master|credit|payment",
    "phone": r"phone|tel\b|call|mobile|fax", "iban": r"iban|bank|account", "ssn": r"ssn|social security",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
REPORT_FROM = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """The check of card numbers: every second digit from the right doubled, sum divisible by ten."""
    def value(x: Column, i: Column) -> Column:
        d = x.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97_valid(code: Column) -> Column:
    """The check of account numbers: the rearranged number leaves 1 when divided by 97."""
    plain = F.regexp_replace(code, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _scored(spans: Column, kind: str, parts: Column) -> Column:
    def one(s: Column) -> Column:
        before = F.lower(cut(parts, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))
        bonus = F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.least(F.lit(1.0), F.lit(SCORES[kind]) + bonus).alias("score"),
        )

    return F.transform(spans, one)


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``parts`` of its text where it has spans, ``base_spans``, ``all_spans``."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    length = lambda s: F.length(_digits(s["match"]))
    found = {
        "email": match_spans(t, EMAIL, "email", 0, F.contains(t, F.lit("@"))),
        "ip": F.filter(match_spans(t, IP, "ip", 1, digit), lambda s: s["match"].rlike(_VALID_IP)),
        "card": F.filter(
            match_spans(t, CARD, "card", 2, digit),
            lambda s: length(s).between(14, 19) & luhn_valid(_digits(s["match"])),
        ),
        "phone": F.filter(match_spans(t, PHONE, "phone", 3, F.contains(t, F.lit("+"))), lambda s: length(s).between(10, 15)),
        "iban": F.filter(match_spans(t, IBAN, "iban", 4, digit), lambda s: mod97_valid(s["match"])),
        "ssn": F.filter(match_spans(t, SSN, "ssn", 5, digit), lambda s: ~s["match"].rlike(_NO_SSN)),
    }
    # Each kind once in its own column, then scored, then put together.
    rows = rows.select("row", "text", *[c.alias(k) for k, c in found.items()])
    some = sum((F.size(k) for k in found), F.lit(0)) > 0
    rows = rows.select("row", *found, F.when(some, pieces(t)).alias("parts"))
    rows = rows.select("row", "parts", *[_scored(F.col(k), k, F.col("parts")).alias(k) for k in found])
    extra = [F.filter(k, lambda s: s["score"] >= REPORT_FROM) for k in ("iban", "ssn")]
    rows = rows.select("row", "parts", in_order(*[F.col(k) for k in BASE_KINDS]).alias("base_spans"), *[e.alias(k) for e, k in zip(extra, ("iban", "ssn"), strict=True)])
    return rows.select("row", "parts", "base_spans", in_order(F.col("base_spans"), F.col("iban"), F.col("ssn")).alias("all_spans"))


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, no, end, kind, score) by start, then kind.

    Base kinds stay whatever their score; added kinds (account numbers, social
    security numbers) are reported from a score of 0.5. A null text is empty, an empty
    table has no rows, repeated rows are rows of their own; spans that start together are ordered by kind.
    Columns of ``docs`` that have these two names are replaced, all others stay. Work grows
    with the length of a text, however many matches it has.
    """
    plain = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    return _found(docs, text).select(*[F.col(f"row.`{c}`") for c in plain], "base_spans", "all_spans")


def span_digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The counts and digests of :func:`find_private`, one row per document."""
    base = F.col("base_spans")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[count_of(base, k).alias(f"n_{k}") for k in BASE_KINDS],
        digest(base).alias("base_sha256"),
        listed(F.col("all_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets; other texts stay as they are.

    Overlapping spans are cut out together under the kind of the first. ``n_chars``,
    where there is such a column, follows the new text. A null text stays null. All other
    columns keep their values, whatever their names; repeated rows stay, an empty table stays empty.
    """
    spans, parts = F.col("all_spans"), F.col("parts")
    ends = before_each(spans, lambda s: s["end"], F.greatest)

    def piece(s: Column, at: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), mark)).otherwise("")

    old = F.col(f"row.`{text}`")
    rest = cut(parts, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(old))
    new = F.concat(F.array_join(F.zip_with(spans, ends, piece), ""), rest)
    # The changed text once, in a column of its own.
    out = _found(docs, text).select("row", F.explode(F.array(F.when(F.size("all_spans") > 0, new))).alias("new"))
    columns = []
    for c in docs.columns:
        column = F.col(f"row.`{c}`")
        if c == text:
            column = F.coalesce("new", column)
        elif c == n_chars:
            column = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return out.select(*columns)
