"""Per-table transforms from source to target shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.config import Transform
from driftwarden.functions import conversion as cv


def transform_vendor(df: DataFrame) -> DataFrame:
    return df.drop("vendor_tier").withColumn("active_flag", cv.char_to_boolean(F.col("active_flag")))


def transform_inventory(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "unit_cost": cv.decimal_to_float(F.col("unit_cost")),
        "last_counted_ts": cv.shift_timestamp(F.col("last_counted_ts")),
    })


def transform_purchase_order(df: DataFrame) -> DataFrame:
    return df


def status_to_is_deleted(df: DataFrame) -> DataFrame:
    return df.withColumn("is_deleted", cv.is_soft_deleted(F.col("status_code"))).drop("status_code")


def filter_soft_deleted(df: DataFrame) -> DataFrame:
    """Drop deleted rows by the stored status, so that the filter can reach the file scan."""
    return df.filter(~cv.is_soft_deleted(F.col("status_code")))


def transform_inventory_transaction(df: DataFrame) -> DataFrame:
    kept = filter_soft_deleted(df).withColumn("txn_ts", cv.shift_timestamp(F.col("txn_ts")))
    return status_to_is_deleted(kept)


def transform_supplier_contract(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "terms_notes": cv.empty_to_null(F.col("terms_notes")),
        "auto_renew": cv.char_to_boolean(F.col("auto_renew")),
    })


TRANSFORMS: dict[str, Transform] = {
    "vendor": transform_vendor,
    "inventory": transform_inventory,
    "inventory_transaction": transform_inventory_transaction,
    "supplier_contract": transform_supplier_contract,
    "purchase_order": transform_purchase_order,
}
