"""Tenant scopes: the only way to the evidence tables, and the check on what is written to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantScope:
    """Tables as one tenant sees them. Without a tenant every table is empty."""

    tenant_id: str | None
    open_table: Callable[[str], DataFrame]

    def table(self, name: str) -> DataFrame:
        df = self.open_table(name)
        return df.where(F.col("tenant_id") == F.lit(self.tenant_id)) if self.tenant_id is not None else df.where(F.lit(False))

    def check_write(self, rows: DataFrame, parent: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
        """The rows, failing in the task that meets a row of another tenant; children need a parent of the tenant."""
        own = F.col("tenant_id").eqNullSafe(F.lit(self.tenant_id))
        out = rows.withColumn("tenant_id", F.when(own, F.col("tenant_id")).otherwise(F.raise_error(F.lit("a row of another tenant"))))
        if parent is None:
            return out
        known = parent.where(F.col("tenant_id") == F.lit(self.tenant_id)).select(F.col(key).alias("_parent")).distinct()
        found = out.join(known, out[key] == F.col("_parent"), "left")
        return found.withColumn(key, F.when(F.col("_parent").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no parent of this tenant: "), F.col(key).cast("string"))))).drop("_parent")
