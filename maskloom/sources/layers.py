"""The five layers of a document's life as Parquet tables, and what may leave them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Layer names in order.
LAYERS = ("1_original", "2_extracted", "3_anonymized", "4_validation", "5_chat_context")
LOCAL_ONLY = LAYERS[:2]
SHAREABLE = LAYERS[4:]
#: Columns that hold raw values and never go beyond layer 2.
RAW = frozenset({"value", "text", "mapping", "content", "restored", "surface"})


class LayerError(ValueError):
    pass


def write_layer(df: DataFrame, root: str, layer: str, mode: str = "mapping", **options: str) -> None:
    """Append to a layer. Destructive mode never writes layers 1 and 2; raw columns never go to 3, 4 and 5."""
    if layer not in LAYERS:
        raise LayerError(f"no such layer: {layer}")
    if layer in LOCAL_ONLY:
        if mode == "destructive":
            return
    elif raw := RAW & set(df.columns):
        raise LayerError(f"raw columns in {layer}: {sorted(raw)}")
    df.write.mode("append").options(**options).parquet(f"{root}/{layer}")


def read_layer(spark: SparkSession, root: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{layer}")


def read_shareable(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """A layer that may be sent on; any other is refused."""
    if layer not in SHAREABLE:
        raise LayerError(f"{layer} must not leave the store")
    return read_layer(spark, root, layer)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON log."""
    df.write.mode("append").json(path)
