"""Byte framing of log entries and timestamp lists, as native column expressions.

Every function takes and returns columns; nothing leaves the JVM. Byte
positions in ``F.substring`` count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Largest instant with a four-digit year, in milliseconds.
MAX_MILLIS = 253402300799999

# Hash algorithm numbers of TLS 1.2 signatures.
HASH_NAMES = {1: "md5", 2: "sha1", 3: "sha224", 4: "sha256", 5: "sha384", 6: "sha512"}


def _uint(data: Column, start: int | Column, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes; null when it passes BIGINT."""
    piece = F.substring(data, start, width)
    return F.conv(F.hex(piece), 16, 10).try_cast("bigint")


def from_base64(text: Column) -> Column:
    """Bytes of base64 text, null when the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def to_base64(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def leaf_timestamp(leaf: Column) -> Column:
    """Milliseconds since the epoch, null when the leaf has fewer than 10 bytes."""
    return F.when(F.length(leaf) >= 10, _uint(leaf, 3, 8))


def millis_to_iso(ms: Column) -> Column:
    """UTC ISO text; the fraction is printed only when it is not zero."""
    whole = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    fraction = F.when(part == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("000"))
    )
    return F.when(
        ms.between(0, MAX_MILLIS), F.concat(whole, fraction, F.lit("+00:00"))
    )


def leaf_version(leaf: Column) -> Column:
    return F.when(F.length(leaf) >= 12, _uint(leaf, 1, 1))


def leaf_type(leaf: Column) -> Column:
    return F.when(F.length(leaf) >= 12, _uint(leaf, 2, 1))


def entry_type(leaf: Column) -> Column:
    return F.when(F.length(leaf) >= 12, _uint(leaf, 11, 2))


_X509, _PRECERT = "0000", "0001"


def _type_hex(leaf: Column) -> Column:
    return F.hex(F.substring(leaf, 11, 2))


def header_error(leaf: Column) -> Column:
    """Why a leaf is refused by its header alone; null when it is accepted."""
    return (
        F.when(leaf.isNull(), F.lit("bad_base64"))
        .when(F.length(leaf) < 12, F.lit("leaf_too_short"))
        .when(F.hex(F.substring(leaf, 1, 2)) != "0000", F.lit("unsupported_header"))
        .when(~_type_hex(leaf).isin(_X509, _PRECERT), F.lit("unknown_entry_type"))
    )


def payload(leaf: Column, extra: Column) -> Column:
    """The bytes that begin with the certificate's 24-bit length, by entry type."""
    kind = _type_hex(leaf)
    return F.when(kind == _X509, F.substring(leaf, 13, 2147483647)).when(kind == _PRECERT, extra)


def payload_size(data: Column) -> Column:
    """The 24-bit length; null when there are fewer than three bytes."""
    return F.when(F.length(data) >= 3, _uint(data, 1, 3).cast("int"))


def payload_error(data: Column, size: Column, is_precert: Column) -> Column:
    return (
        F.when(is_precert & (F.coalesce(F.length(data), F.lit(0)) == 0), F.lit("missing_extra_data"))
        .when(size.isNull(), F.when(is_precert, F.lit("extra_data_too_short")).otherwise(F.lit("leaf_too_short")))
        .when(F.length(data) < size + 3, F.lit("length_exceeds_buffer"))
    )


def _error(leaf: Column, data: Column, wanted: str, other: str) -> Column:
    kind = _type_hex(leaf)
    refused = F.when(kind != wanted, F.lit(other)).otherwise(
        payload_error(data, payload_size(data), F.lit(wanted == _PRECERT))
    )
    return F.coalesce(header_error(leaf), refused)


def x509_error(leaf: Column) -> Column:
    """Why the certificate of a full-certificate leaf cannot be cut out; null when it can."""
    return _error(leaf, F.substring(leaf, 13, 2147483647), _X509, "not_x509_entry")


def x509_der(leaf: Column) -> Column:
    data = F.substring(leaf, 13, 2147483647)
    return F.when(x509_error(leaf).isNull(), F.substring(data, 4, payload_size(data)))


def precert_error(leaf: Column, extra: Column) -> Column:
    """Why the certificate of a precertificate entry cannot be cut out; null when it can."""
    return _error(leaf, extra, _PRECERT, "not_precert_entry")


def precert_der(leaf: Column, extra: Column) -> Column:
    return F.when(precert_error(leaf, extra).isNull(), F.substring(extra, 4, payload_size(extra)))


def fingerprint(der: Column) -> Column:
    return F.sha2(der, 256)


def normalize_fingerprint(text: Column) -> Column:
    """The hexadecimal digits of a text, in lower case; all else is left out."""
    # Pairs are shown between colons, whose removal needs no pattern; only texts with anything else are searched.
    plain = F.replace(text, F.lit(":"), F.lit(""))
    pure = F.rlike(plain, F.lit(r"^[0-9a-fA-F]*+\z"))
    return F.lower(F.when(pure, plain).otherwise(F.regexp_replace(plain, "[^0-9a-fA-F]", "")))


def is_sha256_hex(text: Column) -> Column:
    return F.length(normalize_fingerprint(text)) == 64


def pem(der: Column) -> Column:
    """PEM text: base64 in lines of 64 characters between the armour lines."""
    lines = F.regexp_replace(to_base64(der), "(.{1,64})", "$1\n")
    return F.concat(
        F.lit("-----BEGIN CERTIFICATE-----\n"), lines, F.lit("-----END CERTIFICATE-----\n")
    )


def pem_to_der(raw: Column) -> Column:
    """DER of a file's bytes: the first PEM block when there is one, else the bytes."""
    text = F.decode(raw, "ISO-8859-1")
    body = F.regexp_extract(text, "-----BEGIN [^-]*-----([^-]*)-----END", 1)
    packed = from_base64(F.regexp_replace(body, "\\s", ""))
    return F.when(F.contains(text, F.lit("-----BEGIN")), packed).otherwise(raw)


def _walk_scts(blob: Column, items: bool = True) -> Column:
    """The parts of a timestamp list, where the walk ended, and how many parts were too short.

    A part is its 1-based number ``no`` in the list and its bytes ``sct``. A serialized
    timestamp has at least 47 bytes, which bounds the walk; a shorter part is
    stepped over, and the parts behind it keep their numbers. Only a list with short
    parts, which may be of two bytes each, is walked on beyond that bound. Without ``items``
    the parts are passed over, not cut out.
    """
    total = F.length(blob)

    def steps(width: int) -> Column:
        return F.sequence(F.lit(1), F.greatest(F.lit(1), (total / width).cast("int") + 1))

    def size_at(at: Column) -> Column:
        return F.coalesce(_uint(blob, at, 2).cast("int"), F.lit(0))

    # The size of the part ahead is carried along: each step decodes one length, however often it asks for it.
    start = [F.lit(3).alias("at"), size_at(F.lit(3)).alias("size"), F.lit(0).alias("short")]
    if items:
        start.append(F.array().cast("array<struct<no:int,sct:binary>>").alias("items"))

    def step(state: Column, _: Column) -> Column:
        at, size = state["at"], state["size"]
        inside = (at + 1 <= total) & (at + 1 + size <= total)
        after = [
            F.when(inside, at + 2 + size).otherwise(at).alias("at"),
            F.when(inside, size_at(at + 2 + size)).otherwise(size).alias("size"),
            (state["short"] + (inside & (size < 47)).cast("int")).alias("short"),
        ]
        if items:
            part = F.struct(
                (F.size(state["items"]) + state["short"] + 1).alias("no"), F.substring(blob, at + 2, size).alias("sct")
            )
            kept = F.when(inside & (size >= 47), F.concat(state["items"], F.array(part))).otherwise(state["items"])
            after.append(kept.alias("items"))
        return F.struct(*after)

    def walk_on(walked: Column) -> Column:
        unfinished = (walked["short"] > 0) & (walked["at"] < total + 1)
        return F.aggregate(F.when(unfinished, steps(2)).otherwise(F.array().cast("array<int>")), walked, step)

    return F.transform(F.array(F.aggregate(steps(49), F.struct(*start), step)), walk_on)[0]


def split_scts(blob: Column) -> Column:
    """The serialized timestamps of a list: 2-byte total, then 2-byte length and bytes each."""
    return _walk_scts(blob)["items"]["sct"]


def numbered_scts(blob: Column) -> Column:
    """As :func:`split_scts`, each with ``no``, its place in the list, in which short parts count."""
    return _walk_scts(blob)["items"]


def sct_list_error(blob: Column) -> Column:
    """Why a timestamp list is broken, null when it is whole.

    ``length_mismatch``: the list's own total is not its size. ``bad_length``: a part
    is too short, or its length leads behind the end.
    """
    declared = F.coalesce(_uint(blob, F.lit(1), 2).cast("int"), F.lit(-1))

    def judged(walked: Column) -> Column:
        return F.when((walked["short"] > 0) | (walked["at"] != F.length(blob) + 1), F.lit("bad_length"))

    # Bound once, so the list is not walked again for each of its results.
    walk = F.transform(F.array(_walk_scts(blob, items=False)), judged)[0]
    return F.when(
        blob.isNotNull(), F.when(declared != F.length(blob) - 2, F.lit("length_mismatch")).otherwise(walk)
    )


def sct_log_id(sct: Column) -> Column:
    return to_base64(F.substring(sct, 2, 32))


def sct_millis(sct: Column) -> Column:
    return _uint(sct, 34, 8)


def sct_version(sct: Column) -> Column:
    number = _uint(sct, 1, 1)
    return F.when(number == 0, F.lit("Version.v1")).otherwise(number.cast("string"))


def sct_hash(sct: Column) -> Column:
    """Hash algorithm name; it follows the extensions, whose length is at byte 42."""
    number = _uint(sct, F.lit(44) + _uint(sct, 42, 2).cast("int"), 1)
    out = F.when(F.lit(False), F.lit(""))
    for code, name in HASH_NAMES.items():
        out = out.when(number == code, F.lit(name))
    return out.otherwise(number.cast("string"))
