"""JSON-LD blocks to business fields, with the JSON kept as VARIANT so value types stay visible."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom import fixed_values as V
from leadloom.functions.binding import apply, let
from leadloom.functions.html import BLANKS

_OBJECT = "map<string,variant>"


def entries(blocks: Column) -> Column:
    """Objects of all parseable blocks: a block is one object or a list of them.

    Text that is no strict JSON, NaN included, is skipped. A repeated key keeps its last value, by the
    setting that ``session.tune`` makes.
    """
    def of_block(block):
        return let(
            F.try_parse_json(block),
            lambda parsed: F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed)),
        )

    objects = F.flatten(F.transform(blocks, of_block))
    return F.filter(
        F.transform(objects, lambda e: F.try_variant_get(e, "$", _OBJECT)), lambda m: m.isNotNull()
    )


_TEXT = (
    f"v -> CASE WHEN schema_of_variant(v) = 'STRING' THEN"
    f" nullif(trim(BOTH '{BLANKS}' FROM try_variant_get(v, '$', 'string')), '') END"
)


def _text(value: Column) -> Column:
    """Stripped text of a JSON string; NULL for other JSON types and blank strings."""
    return apply(_TEXT, value)


def _texts(value: Column) -> Column:
    """A string or a list of values, as an array of the strings among them."""
    listed = let(value, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    return F.filter(F.transform(listed, _text), lambda t: t.isNotNull())


def _field(name: Column, value: Column) -> Column:
    return F.struct(
        name.alias("field_name"),
        value.alias("field_value"),
        F.lit("json-ld").alias("extraction_method"),
        F.lit(V.JSON_LD_CONFIDENCE).alias("confidence"),
    )


def _pick(entry: Column, pairs) -> Column:
    """Fields for ``(key, field name)`` pairs of a JSON object, NULL values included."""
    wanted = F.expr("array(" + ", ".join(f"struct('{key}' AS key, '{name}' AS name)" for key, name in pairs) + ")")
    return F.transform(wanted, lambda p: _field(p["name"], _text(F.try_element_at(entry, p["key"]))))


def fields(entry_maps: Column) -> Column:
    """Fields of all entries in order: scalars, address parts, sameAs links, product fields."""
    def of_entry(entry):
        address = F.try_variant_get(F.try_element_at(entry, F.lit("address")), "$", _OBJECT)
        same_as = F.transform(
            _texts(F.try_element_at(entry, F.lit("sameAs"))), lambda url: _field(F.lit("sameAs"), url)
        )
        is_product = F.exists(
            _texts(F.try_element_at(entry, F.lit("@type"))), lambda t: t.contains("Product")
        )
        product = F.filter(_pick(entry, V.JSON_LD_PRODUCT), lambda _: is_product)
        return F.concat(_pick(entry, V.JSON_LD_SCALARS), _pick(address, V.JSON_LD_ADDRESS), same_as, product)

    everything = F.flatten(F.transform(entry_maps, of_entry))
    return F.filter(everything, lambda f: f["field_value"].isNotNull())
