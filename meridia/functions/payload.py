"""Survey payloads and stored data as VARIANT, so that nested values survive reading and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def parsed(payload: Column) -> Column:
    """VARIANT of a JSON text; null where it is none."""
    return F.try_parse_json(payload)


def _object(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", OBJECT))


def attributes(payload: Column) -> Column:
    """Members of a survey payload in any of its three shapes: feature.attributes, attributes, or flat.

    A feature without attributes counts as its own attributes.  The geometry's x and
    y become longitude and latitude where the attributes name none and they are
    not 0.  What is no object has no members.
    """
    whole = parsed(payload)
    feature = F.try_variant_get(whole, "$.feature", "variant")
    inner = F.coalesce(_object(F.try_variant_get(feature, "$.attributes", "variant")), _object(feature))
    at = lambda axis: F.try_variant_get(feature, f"$.geometry.{axis}", "variant")

    def placed(members: Column, name: str, axis: str) -> Column:
        given = F.coalesce(F.try_variant_get(feature, f"$.geometry.{axis}", "double") != 0, F.lit(False))
        return F.when(given & ~F.map_contains_key(members, name), F.map_concat(members, F.create_map(F.lit(name), at(axis)))).otherwise(members)

    flat = F.coalesce(_object(F.try_variant_get(whole, "$.attributes", "variant")), _object(whole))
    return F.when(feature.isNotNull(), placed(placed(inner, "longitude", "x"), "latitude", "y")).otherwise(flat)


def member(members: Column, name: str, kind: str = "string") -> Column:
    """One member as a plain type; null where it is absent or of another kind."""
    return F.try_variant_get(F.try_element_at(members, F.lit(name)), "$", kind)


def inside(members: Column, name: str, path: str, kind: str = "string") -> Column:
    """A value below one member, by a path like ``$.tags[1]``."""
    return F.try_variant_get(F.try_element_at(members, F.lit(name)), path, kind)


def merged_json(old: Column, new: Column) -> Column:
    """Both objects as one JSON text; members of ``new`` win whole, nested values and nulls included.

    Where one of them is no object, or no JSON, the other stands; null if neither is one.
    """
    a, b = _object(parsed(old)), _object(parsed(new))
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return F.to_json(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both))
