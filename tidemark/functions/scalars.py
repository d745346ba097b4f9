"""Scalar functions as Column expressions; only the checksum and the block cipher's odd cases need more than built-ins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: The polynomial and start of the MPEG-2 checksum.
CRC_POLYNOMIAL, CRC_START = 0x04C11DB7, 0xFFFFFFFF


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity, to BIGINT."""
    return F.floor(x + 0.5).cast("bigint")


def half_even(x: Column) -> Column:
    """Rounds half to the even neighbour, to BIGINT, as SQL's cast of a DOUBLE does."""
    return F.rint(x).cast("bigint")


def ticks(seconds: Column, scale: int = 90_000) -> Column:
    return half_up(seconds * scale)


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def leading_float(text: Column) -> Column:
    """The finite decimal number that a text begins with, or null."""
    x = F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def hex_value(text: Column) -> Column:
    """The bytes of 0x and digits in hexadecimal; an odd number of them gets a leading 0; null if it isn't one."""
    digits = F.nullif(F.regexp_extract(text, r"^0[xX]([0-9A-Fa-f]+)$", 1), F.lit(""))
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))


def size_value(text: Column) -> Column:
    """struct<width, height> of a resolution, or null."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^([0-9]+)x([0-9]+)$", i), F.lit("")).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("width"), part(2).alias("height")))


def yes_value(text: Column) -> Column:
    """Whether a text is YES; null is not."""
    return text.eqNullSafe(F.lit("YES"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def expected_bytes(declared: Column, bitrate: Column, duration: Column) -> Column:
    """The declared size of a body if it is above 0, else what its bitrate and duration suggest."""
    return F.when(declared > 0, declared).otherwise(F.ceil(bitrate * duration / 8)).cast("bigint")


def content_length(text: Column) -> Column:
    """The whole number that a header's value begins with, or null."""
    return leading_int(text)


def header_map(text: Column) -> Column:
    """map<name, value> of header lines; names small, the last of equal names wins, lines without a colon go."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.locate(":", x) > 1)
    pair = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.locate(":", x) + 1)).alias("v")))
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def quality(text: Column) -> Column:
    """struct<kind, value> of a quality option: highest, lowest, index:N or maxBitrate:N; null if it is none of them."""
    n = leading_int(F.substring_index(text, ":", -1))
    kind = F.when(text.isin("highest", "lowest"), text).when(n.isNotNull(), F.regexp_extract(text, "^(index|maxBitrate):", 1))
    kind = F.nullif(kind, F.lit(""))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind.isin("index", "maxBitrate"), n).alias("value")))


#: Half-lives (fast, slow), cold-start estimate, factors to keep and to go up, starvation slack, by preset.
PRESETS = {"default": (3.0, 9.0, 500_000, 0.95, 0.70, 4.0), "unstable": (2.0, 4.0, 250_000, 0.80, 0.60, 2.0)}


def preset(text: Column) -> Column:
    """struct<fast, slow, estimate, keep, up, slack> of a preset's name, or null."""
    fields = ("fast", "slow", "estimate", "keep", "up", "slack")
    found = [F.when(text == name, F.struct(*(F.lit(x).alias(f) for f, x in zip(fields, values, strict=True)))) for name, values in PRESETS.items()]
    return F.coalesce(*found)


def names(text: Column) -> Column:
    """The names of a list with commas, trimmed, empty ones left out; the one name `all` is kept as it is."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def poll_delay(target: Column, least: int = 500) -> Column:
    """Milliseconds until a live playlist is loaded again: half its target duration, at least 500."""
    return F.greatest(F.lit(least), F.ceil(target * 500)).cast("bigint")


def language_code(name: Column) -> Column:
    """Three letters, small, padded; und if there is none."""
    letters = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]", "")
    return F.when(letters == "", "und").otherwise(F.rpad(F.substring(letters, 1, 3), 3, " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-")


def sequence_iv(seq: Column) -> Column:
    """The 16-byte big-endian form of a sequence number."""
    return F.unhex(F.lpad(F.hex(seq), 32, "0"))


def decrypt_cbc(body: Column, key: Column, iv: Column) -> Column:
    """AES-128-CBC with PKCS padding; null where the key, IV or body can't be right."""
    fits = (F.length(key) == 16) & (F.length(iv) == 16) & (F.length(body) > 0) & (F.length(body) % 16 == 0)
    return F.when(fits, F.try_aes_decrypt(F.concat(iv, body), key, F.lit("CBC"), F.lit("PKCS")))


def clear_body(method: Column, body: Column, key: Column, iv: Column) -> Column:
    """struct<body, error> of a segment: as it is without a method, decrypted with AES-128; other methods, a missing key and a
    body that doesn't decrypt set error, so that one segment doesn't end a job."""
    plain = decrypt_cbc(body, key, iv)
    whole = F.coalesce(method == "AES-128", F.lit(False))
    open_ = F.coalesce(method == "NONE", F.lit(True))
    error = F.when(open_, F.lit(None)).when(~whole, F.concat(F.lit("unsupported method "), method)).when(key.isNull(), "no key").when(plain.isNull(), "not decrypted")
    return F.struct(F.when(open_, body).when(whole, plain).alias("body"), error.cast("string").alias("error"))


def pack_stamp(pts: Column, prefix: int = 2) -> Column:
    """The 40-bit field of a 33-bit time stamp: prefix and three parts, each followed by a marker bit."""
    part = lambda low, bits: F.shiftright(pts, low).bitwiseAND(F.lit((1 << bits) - 1))
    shifted = [F.shiftleft(part(30, 3), 33), F.shiftleft(part(15, 15), 17), F.shiftleft(part(0, 15), 1)]
    out = F.lit((prefix << 36) | (1 << 32) | (1 << 16) | 1)
    for x in shifted:
        out = out.bitwiseOR(x)
    return out


def unpack_stamp(field: Column) -> Column:
    part = lambda low, bits: F.shiftright(field, low).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(part(33, 3), 30).bitwiseOR(F.shiftleft(part(17, 15), 15)).bitwiseOR(part(1, 15))


def pack_clock(base: Column) -> Column:
    """The 48-bit field of a 33-bit clock: base, six reserved ones, extension 0."""
    return F.shiftleft(base.bitwiseAND(F.lit((1 << 33) - 1)), 15).bitwiseOR(F.lit(0x3F << 9))


def retry_delay(attempt: Column, base: int = 200, most: int = 5000) -> Column:
    """Milliseconds to wait before a retry, without jitter."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | status.between(500, 599)


def media_format(uri: Column) -> Column:
    """Format by the suffix of a uri without its query and fragment."""
    path = F.lower(F.substring_index(F.substring_index(uri, "?", 1), "#", 1))
    return F.when(path.endswith(".aac"), "aac").when(path.rlike(r"\.(ts|m2ts)$"), "ts").when(path.rlike(r"\.(m4s|m4a|mp4)$"), "fmp4").otherwise("unknown")


def body_format(body: Column) -> Column:
    """Format by the first bytes."""
    at = lambda i, n: F.hex(F.substring(body, i + 1, n))
    is_ts = (at(0, 1) == "47") & ((F.length(body) < 189) | (at(188, 1) == "47"))
    return F.when(at(0, 2).rlike("^FFF"), "aac").when(at(4, 4) == "66747970", "fmp4").when(is_ts, "ts").otherwise("unknown")


def clock_ticks(text: Column) -> Column:
    """[[h:]m:]s[.fff] in 90 kHz ticks; -1 if it isn't one."""
    m = lambda i: F.regexp_extract(text, r"^(?:(?:([0-9]+):)?([0-9]+):)?([0-9]+)(?:\.([0-9]{1,3})[0-9]*)?$", i)
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("bigint"), F.lit(0))
    ms = (number(m(1)) * 3600 + number(m(2)) * 60 + number(m(3))) * 1000 + number(F.rpad(m(4), 3, "0"))
    return F.when(m(3) == "", -1).otherwise(ms * 90).cast("bigint")


def attributes(text: Column) -> Column:
    """map<name, value> of NAME=VALUE lists; quoted values may hold commas; the last of equal names wins."""
    parts = F.regexp_extract_all(text, F.lit(r'[^=,\s]+=(?:"[^"]*"?|[^,]*)'), F.lit(0))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.substr(x, F.locate("=", x) + 1), '^"|"$', "").alias("v")))
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda q: q["k"] == p["k"]))
    # As an array of one, so that the pairs are made once and not again for each of them.
    made = F.transform(F.array(pairs), lambda all_: F.map_from_entries(last(all_)))
    return F.get(made, F.lit(0))


_TABLE = []
for _byte in range(256):
    _crc = _byte << 24
    for _ in range(8):
        _crc = ((_crc << 1) ^ CRC_POLYNOMIAL) & 0xFFFFFFFF if _crc >> 31 else (_crc << 1) & 0xFFFFFFFF
    _TABLE.append(_crc)
_TABLE = np.array(_TABLE, np.uint32)


def crc32_mpeg2_of(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(_TABLE[(crc >> 24) ^ byte])
    return crc


@pandas_udf(LongType())
def crc32_mpeg2(data: pd.Series) -> pd.Series:
    """CRC-32/MPEG-2 of each value, all values of a batch in step: one vector operation for each byte position."""
    known = [x if x is not None else b"" for x in data]
    crc = np.full(len(known), CRC_START, np.uint32)
    sizes = np.array([len(x) for x in known], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(known), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(known) else sizes
    for i in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(-sizes[order], -i, "left")]
        crc[live] = (crc[live] << np.uint32(8)) ^ _TABLE[(crc[live] >> np.uint32(24)) ^ flat[begin[live] + i]]
    return pd.Series([int(c) if x is not None else None for c, x in zip(crc, data, strict=True)], dtype="Int64")


#: The hexadecimal digits, and each with its bits in the other order.
_DIGITS, _MIRRORED = "0123456789ABCDEF", "084C2A6E195D3B7F"


def crc32_mpeg2_short(data: Column) -> Column:
    """crc32_mpeg2 of short values without Python: it is the usual CRC-32 with the bits of each byte, and those of the result, in the other order."""
    mirrored = F.unhex(F.translate(F.regexp_replace(F.hex(data), "(.)(.)", "$2$1"), _DIGITS, _MIRRORED))
    crc = F.crc32(mirrored).bitwiseXOR(F.lit(0xFFFFFFFF))
    return F.conv(F.translate(F.reverse(F.lpad(F.hex(crc), 8, "0")), _DIGITS, _MIRRORED), 16, 10).cast("bigint")
