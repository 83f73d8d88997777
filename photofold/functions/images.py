"""Brightness, sharpness and 64-bit difference hash of encoded image bytes.

All three are defined on the base64 text of the content. Base64 is a fixed
mapping of 3 bytes to 4 characters, so the length and any single character are
computed from the bytes they come from; the text itself is never built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photofold.config import BlurConfig
from photofold.functions.binding import column, let

# Fixed values of the feature formulas.
LUMA_SAMPLE = 1000
LUMA_LOW, LUMA_HIGH, LUMA_DEFAULT = 43, 122, 128
SIZE_LOW, SIZE_HIGH, SCORE_MAX, SCORE_DEFAULT = 5000, 50000, 500, 150.0
HASH_BITS = 64


def base64_length(content: Column | str) -> Column:
    """Length of the unbroken base64 text of a binary column."""
    return (F.floor((F.coalesce(F.octet_length(column(content)), F.lit(0)) + 2) / 3) * 4).cast("int")


def _base64(content: Column) -> Column:
    return F.translate(F.base64(content), "\r\n", "")


def mean_luma(content: Column | str) -> Column:
    """Mean character code of the first 1000 base64 characters, scaled to 0…255."""
    content = column(content)
    sample = _base64(F.substring(content, 1, LUMA_SAMPLE // 4 * 3))
    codes = F.aggregate(
        F.split(sample, ""), F.lit(0), lambda total, char: total + F.ascii(char)
    )
    n = F.least(F.lit(LUMA_SAMPLE), base64_length(content))
    scaled = (codes / n - LUMA_LOW) / (LUMA_HIGH - LUMA_LOW) * 255
    return F.when(n > 0, F.floor(scaled + 0.5).cast("double")).otherwise(F.lit(float(LUMA_DEFAULT)))


def laplacian_var(content: Column | str) -> Column:
    """Sharpness from the encoded size, clamped to 0…500."""
    n = base64_length(content)
    scaled = (n - SIZE_LOW) / (SIZE_HIGH - SIZE_LOW) * SCORE_MAX
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(float(SCORE_MAX)), scaled))
    return F.when(n > 0, clamped).otherwise(F.lit(SCORE_DEFAULT))


def dhash64(content: Column | str) -> Column:
    """Compare 65 evenly spaced base64 characters; 16 lower-case hex digits."""
    content = column(content)
    step = F.floor(base64_length(content) / (HASH_BITS + 1)).cast("int")

    def char_code(at: Column) -> Column:
        triple = F.substring(content, F.floor(at / 4).cast("int") * 3 + 1, F.lit(3))
        return F.ascii(F.substring(F.base64(triple), at % 4 + 1, F.lit(1)))

    def digits(codes: Column) -> Column:
        # The first pair is the lowest bit, so the pairs are written from last to first.
        bits = F.transform(
            F.sequence(F.lit(HASH_BITS - 1), F.lit(0)),
            lambda i: F.when(F.get(codes, i) < F.get(codes, i + 1), "1").otherwise("0"),
        )
        hexed = F.conv(F.array_join(bits, ""), 2, 16)
        return F.lower(F.lpad(hexed, HASH_BITS // 4, "0"))

    def codes_at(gap: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(HASH_BITS)), lambda i: char_code(i * gap))

    blank = F.lit("0" * (HASH_BITS // 4))
    # Below 65 characters the step is 0: every sample is the same character.
    return F.when(step > 0, let(let(step, codes_at), digits)).otherwise(blank)


def hash_bits(phash: Column | str) -> Column:
    """The 64 bits of a hex hash as a signed bigint; NULL when empty or not hex."""
    phash = column(phash)
    return F.when(phash.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(phash, 16, -10).cast("bigint"))


def hamming64(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two hex hashes differ."""
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))


def are_similar(a: Column | str, b: Column | str, threshold: int = 15) -> Column:
    return hamming64(a, b) < threshold


def blur_threshold(luma: Column | str, config: BlurConfig = BlurConfig()) -> Column:
    luma = column(luma)
    return (
        F.when(luma < config.dark_threshold, config.base_threshold * config.dark_multiplier)
        .when(luma > config.bright_threshold, config.base_threshold * config.bright_multiplier)
        .otherwise(F.lit(config.base_threshold))
    )


def resolution_score(width: Column, height: Column) -> Column:
    pixels = F.coalesce(width, F.lit(0)).cast("double") * F.coalesce(height, F.lit(0))
    return F.when(pixels > 0, F.log10(pixels) * 10).otherwise(F.lit(0.0))


def sharpness_score(blur_score: Column) -> Column:
    return F.least(F.coalesce(blur_score, F.lit(0.0)), F.lit(500.0)) / 5


def lighting_score(mean_luma_value: Column) -> Column:
    off = F.abs(F.coalesce(mean_luma_value, F.lit(128.0)) - 140)
    return F.greatest(F.lit(0.0), 40 - off)


def center_crop(width: Column | str, height: Column | str) -> tuple[Column, Column, Column]:
    """(origin_x, origin_y, size) of the centred square."""
    width, height = column(width), column(height)
    size = F.least(width, height)
    # least() skips NULLs; a crop needs both sides.
    size = F.when(width.isNotNull() & height.isNotNull(), size)
    return (width - size) / 2, (height - size) / 2, size
