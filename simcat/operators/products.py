"""Product records -> document text (P-1..P-8) and the load-side validation (V-2, V-3).

A product DataFrame carries raw string fields (as S-1 reads them): id, title,
greatgrandparent_category, grandparent_category, parent_category, category,
description, attributes (raw JSON text of a list), seller, rating (raw number text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions import text as T

CATEGORY_LEVELS = ["greatgrandparent_category", "grandparent_category", "parent_category", "category"]

# Reasons the loader reports.
REASON_MISSING_ID = "Missing 'id' field"
REASON_EMPTY_TEXT = "Empty text after formatting"
REASON_NOT_OBJECT = "Record is not a JSON object"


def attributes_from_json(raw: Column) -> Column:
    """Raw JSON text -> array<string> when it is a list, else null (P-6 input)."""
    is_list = F.ltrim(raw).startswith("[")
    return F.when(is_list, F.from_json(raw, "array<string>"))


def format_products(products: DataFrame, params: P.Params = P.DEFAULT,
                    attributes: Column | None = None) -> Column:
    """P-8 over raw product fields; returns the document-text column.

    ``attributes`` overrides the list column (array<string>) when the caller
    already has one."""
    attrs = attributes if attributes is not None else attributes_from_json(F.col("attributes"))
    return T.product_text(
        title=F.col("title"),
        categories=T.category_path(*[F.col(c) for c in CATEGORY_LEVELS]),
        description=T.clean_description(F.col("description"), params.description_cap),
        attributes=T.attribute_list(attrs, params.attribute_cap),
        seller=F.col("seller"),
        rating=T.rating_text(F.col("rating")),
        labels=params.labels,
    )


def load_reason(id_raw: Column, text: Column) -> Column:
    """V-2 then V-3 (loader side), then the upsert API's own rules V-4 and V-5.

    ``text`` is bound once through a one-element ``aggregate``, so a filter on the
    reason that Catalyst pushes below the projection evaluates the formatting once,
    not once per reference."""
    from simcat.operators.catalog import REASON_ID, REASON_LENGTH

    missing = id_raw.isNull() | F.trim(id_raw).isin("", "0", "0.0", "false")
    rid = T.integral_id(id_raw)

    def of_text(acc, t):
        n = F.char_length(t)
        return (F.when(n == 0, F.lit(REASON_EMPTY_TEXT))
                .when(rid.isNull() | (rid <= 0), F.lit(REASON_ID))
                .when(n > P.MAX_TEXT_CHARS, F.lit(REASON_LENGTH)))

    by_text = F.aggregate(F.array(text), F.lit(None).cast("string"), of_text)
    return F.when(missing, F.lit(REASON_MISSING_ID)).otherwise(by_text)


def load_outcomes(products: DataFrame, params: P.Params = P.DEFAULT,
                  attributes: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per parsed record: record_no, ``keep``, id (bigint or null), text, reason (null = ok)."""
    text = format_products(products, params, attributes)
    with_text = products.withColumn("_text", text)
    reason = load_reason(F.col("id"), F.col("_text"))
    if "not_object" in products.columns:  # a valid JSON value that is not an object (G-3)
        reason = F.when(F.col("not_object"), F.lit(REASON_NOT_OBJECT)).otherwise(reason)
    return with_text.select(
        "record_no", *keep,
        T.integral_id(F.col("id")).alias("id"),
        F.col("_text").alias("text"),
        reason.alias("reason"),
    )
