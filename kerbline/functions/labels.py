"""Label vocabulary columns: normalisation, multi-hot, stable ids, applicability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import vocab


def lookup(value: Column, table: dict) -> Column:
    """Value of a small constant map, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def _strict(found: Column, raw: Column, what: str, strict: bool) -> Column:
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unsupported {what}: "), F.coalesce(raw.cast("string"), F.lit("null")))))


def surface_type(raw: Column, strict: bool = True) -> Column:
    key = F.regexp_replace(F.lower(F.trim(raw)), "-", "_")
    return _strict(lookup(key, vocab.SURFACE_LOOKUP), raw, "surface type", strict)


def quality_grade(raw: Column, strict: bool = True) -> Column:
    """Words only, as text; numeric columns go through `quality_number`."""
    key = F.regexp_replace(F.lower(F.trim(raw)), "-", " ")
    return _strict(lookup(key, vocab.QUALITY_WORDS), raw, "quality", strict)


def quality_number(raw: Column, strict: bool = True) -> Column:
    return _strict(F.when(raw.between(1, 5), raw.cast("int")), raw, "quality", strict)


def label_set(labels: Column, strict: bool = True) -> Column:
    """Aliases mapped, duplicates dropped, vocabulary order, `none` only when alone."""
    known = {**{v: v for v in vocab.LABEL_VOCAB}, **vocab.LABEL_ALIASES}
    mapped = F.transform(labels, lambda x: _strict(lookup(x, known), x, "label", strict))
    defects = F.array_compact(
        F.array(*[F.when(F.array_contains(mapped, v), F.lit(v)) for v in vocab.DEFECT_LABELS])
    )
    return F.when(F.size(defects) > 0, defects).otherwise(F.array(F.lit("none")))


def annotation_label(classes: Column) -> Column:
    """Per-image class names to labels; an image without annotation counts as crack."""
    crack = F.arrays_overlap(classes, F.array(*map(F.lit, ["D00", "D10", "D20"])))
    pothole = F.array_contains(classes, "D40")
    both = F.array_compact(F.array(F.when(crack, F.lit("crack")), F.when(pothole, F.lit("pothole"))))
    labels = F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("none")))
    return F.coalesce(F.when(classes.isNotNull(), labels), F.array(F.lit("crack")))


def unified_pavement_label(labels: Column) -> Column:
    hit = F.arrays_overlap(labels, F.array(F.lit("crack"), F.lit("pothole")))
    return F.when(hit, F.lit("crack")).otherwise(F.lit("none"))


def multi_hot(labels: Column, names: list[str] | None = None) -> Column:
    return F.array(*[F.array_contains(labels, n).cast("float") for n in names or vocab.DEFECT_LABELS])


def image_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def normalised_surface(surface: Column) -> Column:
    return F.lower(F.trim(F.coalesce(surface, F.lit("unknown"))))


def infer_domain(source_path: Column, filename: Column, surface: Column) -> Column:
    """Ordered keyword rules over the lower-cased path.

    In the sdnet branch the substring `/d` also matches `/data...`; kept, since
    results depend on it.
    """
    text = F.lower(F.concat(F.coalesce(source_path, F.lit("")), F.lit("/"), F.coalesce(filename, F.lit(""))))

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    sdnet = has("sdnet2018")
    return (
        F.when(has("codebrim", "bridge"), "bridge")
        .when(has("building", "wall"), "building")
        .when(sdnet & has("/d", "deck"), "bridge")
        .when(sdnet & has("/w", "wall"), "building")
        .when(sdnet & has("/p", "pavement"), "pavement")
        .when(has("runway", "crackairport", "airport"), "runway")
        .when(normalised_surface(surface).isin(vocab.PAVED_SURFACES), "pavement")
        .otherwise("unknown")
    )


def structural_context(surface: Column, domain: Column) -> Column:
    """Concrete or an inferred structure, and no surface that rules concrete out."""
    kind = normalised_surface(surface)
    structural = F.lower(F.coalesce(domain, F.lit(""))).isin(vocab.STRUCTURAL_DOMAINS)
    return ~kind.isin(vocab.NON_CONCRETE_SURFACES) & ((kind == "concrete") | structural)


def label_applicable(label: str, surface: Column, domain: Column) -> Column:
    return structural_context(surface, domain) if label in vocab.GATED_LABELS else F.lit(True)


def gated_probability(raw: Column, applicable: Column) -> Column:
    return F.when(applicable, raw).otherwise(F.lit(0.0))
