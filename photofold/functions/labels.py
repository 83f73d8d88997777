"""Detector labels: parsing, filters, broad groups, reranking and translation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from photofold.config import (
    DEFAULT_IMAGE_WIDTH,
    FACE_CONFIDENCE,
    LABEL_CONFIDENCE,
    MAX_LABELS,
    MIN_FACE_RATIO,
    RERANK_BELOW,
)
from photofold.functions.binding import column, let
from photofold.functions.vocabulary import (
    BIRD_WORDS,
    CAT_WORDS,
    DOG_WORDS,
    PEOPLE_DISQUALIFIERS,
    PEOPLE_WORDS,
    SCAN_DISQUALIFIERS,
    SCREENSHOT_PARTS,
    SCREENSHOT_WORDS,
)


def parse_labels(labels_json: Column | str) -> Column:
    """JSON text to labels; NULL when malformed. The old key ``label`` stands in for ``text``."""
    raw = F.from_json(
        column(labels_json), "array<struct<text:string,label:string,confidence:double>>"
    )
    return F.transform(
        raw,
        lambda x: F.struct(
            F.coalesce(F.nullif(x["text"], F.lit("")), x["label"]).alias("text"),
            x["confidence"].alias("confidence"),
        ),
    )


def serialize_labels(labels: Column | str) -> Column:
    """JSON text of the labels; NULL when there are none."""
    labels = column(labels)
    return F.when(F.size(labels) > 0, F.to_json(labels))


def valid_labels(labels: Column | str, above: float = LABEL_CONFIDENCE) -> Column:
    """Labels above the confidence limit, in list order."""
    return F.filter(column(labels), lambda x: x["confidence"] > above)


def top_labels(
    labels: Column | str, n: int = MAX_LABELS, at_least: float = LABEL_CONFIDENCE
) -> Column:
    """The ``n`` best labels at or above the limit, best first; ties keep list order."""
    kept = F.filter(column(labels), lambda x: x["confidence"] >= at_least)
    numbered = F.transform(
        kept, lambda x, i: F.struct((-x["confidence"]).alias("key"), i.alias("i"), x.alias("label"))
    )
    return F.transform(F.slice(F.sort_array(numbered), 1, n), lambda x: x["label"])


def _any_label_in(labels: Column | str, words: Sequence[str]) -> Column:
    hit = F.exists(
        column(labels),
        lambda x: (x["confidence"] > LABEL_CONFIDENCE) & F.lower(x["text"]).isin(*words),
    )
    return F.coalesce(hit, F.lit(False))


def context_disqualified(labels: Column | str) -> Column:
    """While scanning: a confident label says the image is a screen or a page."""
    return _any_label_in(labels, SCAN_DISQUALIFIERS)


def people_disqualified(labels: Column | str) -> Column:
    """In the people report: the same test with that report's own word list."""
    return _any_label_in(labels, PEOPLE_DISQUALIFIERS)


def is_screenshot(labels: Column | str) -> Column:
    """Any label, whatever its confidence, contains one of the screenshot parts."""
    pattern = "|".join(SCREENSHOT_PARTS)
    hit = F.exists(column(labels), lambda x: F.lower(x["text"]).rlike(pattern))
    return F.coalesce(hit, F.lit(False))


def faces_min_size(faces: Column | str, image_width: Column | str) -> Column:
    """Faces wider than a tenth of the image."""
    width = F.coalesce(F.nullif(column(image_width), F.lit(0)), F.lit(DEFAULT_IMAGE_WIDTH))
    limit = width * F.lit(MIN_FACE_RATIO)
    return F.filter(
        column(faces), lambda f: F.coalesce(f["bounding_box"]["width"], F.lit(0.0)) > limit
    )


def valid_face_count(faces: Column | str, labels: Column | str, image_width: Column | str) -> Column:
    """Number of large enough faces; 0 when the context disqualifies them."""
    large = F.coalesce(F.size(faces_min_size(faces, image_width)), F.lit(0))
    return F.when(context_disqualified(labels), F.lit(0)).otherwise(F.greatest(large, F.lit(0)))


def detection_to_face(frame: Column | str) -> Column:
    """Detector frame (origin and size) to a face with the constant confidence."""
    frame = column(frame)
    return F.struct(
        F.struct(
            frame["origin"]["x"].alias("x"),
            frame["origin"]["y"].alias("y"),
            frame["size"]["x"].alias("width"),
            frame["size"]["y"].alias("height"),
        ).alias("bounding_box"),
        F.lit(FACE_CONFIDENCE).alias("confidence"),
    )


def _has_word(text: Column, words: Sequence[str]) -> Column:
    # Word boundaries over ASCII word characters only, whatever the regex engine's default is.
    return text.rlike("(?<![A-Za-z0-9_])(?:" + "|".join(words) + ")(?![A-Za-z0-9_])")


def category_group(label: Column | str) -> Column:
    """Broad group of an English label: cat, dog, bird, screenshot, people or NULL."""
    text = F.lower(column(label))
    prairie_dog = _has_word(text, ["prairie"]) & _has_word(text, ["dog"])
    return (
        F.when(_has_word(text, CAT_WORDS), "cat")
        .when(text == "cardigan", "dog")
        .when(_has_word(text, DOG_WORDS), F.when(~prairie_dog, "dog"))
        .when(_has_word(text, BIRD_WORDS), "bird")
        .when(_has_word(text, SCREENSHOT_WORDS), "screenshot")
        .when(_has_word(text, PEOPLE_WORDS), "people")
    )


def pick_label(labels: Column | str) -> Column:
    """Label that names an image: ``struct<group, label>``, NULL when nothing is usable.

    ``group`` is the broad group; ``label`` is what to translate (the group if there
    is one). A cat or dog among the first five valid labels wins over an unsure
    first label; a people label met before that makes the image a people image.
    """
    candidates = F.transform(
        F.slice(valid_labels(labels), 1, MAX_LABELS),
        lambda x: F.struct(
            x["text"].alias("text"),
            x["confidence"].alias("confidence"),
            category_group(x["text"]).alias("group"),
        ),
    )

    def choose(found: Column) -> Column:
        first = F.get(found, 0)
        unsure = first["confidence"] < RERANK_BELOW
        decisive = F.filter(
            found, lambda c: (c["group"].isin("cat", "dog") & unsure) | (c["group"] == "people")
        )
        return F.when(F.length(first["text"]) > 0, F.coalesce(F.get(decisive, 0), first))

    def named(chosen: Column) -> Column:
        label = F.coalesce(chosen["group"], chosen["text"])
        return F.when(
            chosen.isNotNull(), F.struct(chosen["group"].alias("group"), label.alias("label"))
        )

    return let(let(candidates, choose), named)


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n\f\v"))


def lookup_text(label: Column | str) -> Column:
    """The form of a label under which translations are stored."""
    return _strip(F.lower(column(label)))


def capitalized(label: Column | str) -> Column:
    """First character in upper case, the rest unchanged; '' for NULL."""
    label = F.coalesce(column(label), F.lit(""))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))


def translate_label(
    label: Column | str, language: str, translations: Mapping[str, str] | None = None
) -> Column:
    """Title of a label. For ``zh``: the whole text, else its first translatable comma part.

    ``translations`` becomes a map literal in the plan, so it must be a table of known
    small size; see ``operators.categories.translate`` for tables of any size.
    """
    label = column(label)
    fallback = capitalized(label)
    known = {name: title for name, title in (translations or {}).items() if title}
    if language != "zh" or not known:
        return fallback
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    text = lookup_text(label)
    # The first try is the whole text, then its comma parts in order.
    tries = F.concat(F.array(text), F.split(text, ","))
    names = F.transform(tries, lambda p: F.try_element_at(table, _strip(p)))
    return F.coalesce(F.get(F.array_compact(names), 0), fallback)


def localize(
    translated: Column | str,
    english: Column | str,
    key: Column | str,
    params: Mapping[str, Column | str] | None = None,
) -> Column:
    """Text of a key: language, else English, else the key; fills ``{name}`` at its first use."""
    text = F.coalesce(
        F.nullif(column(translated), F.lit("")), F.nullif(column(english), F.lit("")), column(key)
    )
    for name, value in (params or {}).items():
        mark = "{" + name + "}"
        value = column(value).cast("string")
        at = F.instr(text, mark)
        text = F.when(at > 0, F.overlay(text, value, at, F.lit(len(mark)))).otherwise(text)
    return text


def date_string(taken_at: Column | str) -> Column:
    """Date and minute of an epoch-millisecond column in the session time zone."""
    return F.date_format(F.timestamp_millis(column(taken_at)), "yyyy-MM-dd HH:mm")


def group_id(*parts: Column | str) -> Column:
    """Deterministic group id from the root asset (and library)."""
    return F.concat(F.lit("grp_"), F.concat_ws("_", *[column(p) for p in parts]))


def bbox_json(box: Column | str) -> Column:
    return F.to_json(column(box))
