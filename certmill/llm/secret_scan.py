"""Secrets, with weak candidates reported only beside their complementary parts.

DataFrame operations only. One pass over the texts finds the parts; weak parts are
confirmed by an interval join of access identifiers, secrets and endpoints of one
document that stand within ``SCOPE`` characters of each other. The join is on
(document, stretch of the text), so it sees the parts of a few hundred characters
at a time however long a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.spans import count_of, digest, in_order, listed, match_spans
from certmill.plans.joins import lookup_join
from certmill.session import stored

_NAMES = r"(?i:(password|passwd|secret|token|api_?key))"
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = _NAMES + _VALUE
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Weak kinds: alone they are ordinary text.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,128}+(?![A-Za-z0-9+/_=-])"
WEAK_IDENT = r"""(?i:\b(?:user_?name|user|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,64}"""
ENDPOINT = r"""https?://[^\x00-\x20"'<>]{4,512}+"""

BASE_KINDS = ("assign", "access", "hex")
SCOPE = 300
MIN_VALUE = 8


def _mixed(s: Column) -> Column:
    """Upper case, lower case and digits together, as random tokens have."""
    return s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")


def find_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored row per document: ``row_id, doc_id, base, weak``, the spans found in its text."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = {
        "assign": F.filter(
            match_spans(t, ASSIGN, "assign", 0, t.rlike(_NAMES)),
            lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_VALUE,
        ),
        "access": match_spans(t, ACCESS, "access", 1, F.contains(t, F.lit("AKIA"))),
        "hex": match_spans(t, HEX, "hex", 2),
    }
    weak = {
        "endpoint": match_spans(t, ENDPOINT, "endpoint", 3, F.contains(t, F.lit("://"))),
        "ident": match_spans(t, WEAK_IDENT, "ident", 4, t.rlike("[:=]")),
        "weak_secret": F.filter(match_spans(t, WEAK_SECRET, "weak_secret", 5), lambda s: _mixed(s["match"])),
    }
    rows = rows.select("doc_id", *[c.alias(k) for k, c in {**base, **weak}.items()])
    rows = rows.select("doc_id", in_order(*[F.col(k) for k in base]).alias("base"), in_order(*[F.col(k) for k in weak]).alias("weak"))
    return stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "secret-parts")


def _clear(weak: DataFrame, base: DataFrame, scope: int) -> DataFrame:
    """The weak spans that overlap no base span, by an interval join on the stretches that spans touch."""
    touched = F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"(end - 1) div {scope}"))).alias("stretch")
    others = base.select("row_id", F.col("start").alias("other_start"), F.col("end").alias("other_end"), touched)
    met = weak.select("row_id", "start", "no", "end", touched).join(others, ["row_id", "stretch"])
    met = met.filter((F.col("other_start") < F.col("end")) & (F.col("start") < F.col("other_end")))
    return weak.join(met.select("row_id", "start", "no").distinct(), ["row_id", "start", "no"], "left_anti").select(*weak.columns)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have complementary parts within ``scope`` characters: ``row_id, added``.

    A weak secret needs an identifier, a weak identifier needs a secret, and an
    endpoint needs both. A weak part that overlaps a base span adds nothing.
    """
    some = parts.filter(F.size("weak") > 0)
    spread = lambda c: some.select("row_id", F.explode(c).alias("s")).select("row_id", "s.*").drop("match")
    role = (
        F.when(F.col("kind").isin("access", "ident"), "id")
        .when(F.col("kind").isin("assign", "hex", "weak_secret"), "secret")
        .otherwise("endpoint")
    )
    base, clear = spread("base"), stored(_clear(spread("weak"), spread("base"), scope), "clear-parts")
    weak = clear.withColumn("role", role)
    place = F.expr(f"start div {scope}")
    near = (
        base.unionByName(clear).withColumn("role", role).filter("role <> 'endpoint'")
        .withColumn("stretch", F.explode(F.array(place - 1, place, place + 1)))
        .select("row_id", "stretch", F.col("start").alias("other_start"), F.col("role").alias("other_role")).distinct()
    )
    seen = (
        weak.withColumn("stretch", place).join(near, ["row_id", "stretch"])
        .filter((F.abs(F.col("start") - F.col("other_start")) <= scope) & (F.col("role") != F.col("other_role")))
        .groupBy("row_id", "start", "no", "end", "kind", "role")
        .agg(F.count_distinct("other_role").alias("roles"))
    )
    kept = seen.filter((F.col("role") != "endpoint") | (F.col("roles") == 2))
    span = F.struct("start", "no", "end", "kind", F.lit(None).cast("string").alias("match"))
    return kept.groupBy("row_id").agg(F.collect_list(span).alias("added"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: ``doc_id, base_spans, all_spans``; a null text is empty.

    ``all_spans`` has the base spans and the weak ones that :func:`link_parts` confirms, by start,
    then kind. Repeated rows are rows of their own, an empty table has none, other columns are not read.
    """
    parts = find_parts(docs, doc_id, text)
    added = stored(link_parts(parts, scope), "linked-parts")
    rows = lookup_join(parts.drop("weak"), added, "row_id", "left")
    more = F.coalesce("added", F.filter("base", lambda s: F.lit(False)))
    return rows.select("doc_id", F.col("base").alias("base_spans"), in_order(F.col("base"), more).alias("all_spans"))


def span_digests(found: DataFrame) -> DataFrame:
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{k}") for k in BASE_KINDS],
        digest(base).alias("base_sha256"),
        listed(F.col("all_spans")).alias("spans"),
    )
