"""The Parquet warehouse: prices and quarantine by day, products, ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PRICES, PRODUCTS


class Warehouse:
    """Tables under ``root``, any store that Spark reaches. Days are partitions, overwritten whole and atomically by the commit protocol."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _status(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.listStatus(path) if files.exists(path) else None

    def stored_days(self, name: str = "prices") -> list[str]:
        """The partitions with a day for a name that hold files; others are left aside."""
        found = self._status(name) or []
        names = [x.getPath().getName() for x in found if x.isDirectory()]
        days = [m[1] for n in names if (m := re.fullmatch(r"date=(\d{4}-\d{2}-\d{2})", n))]
        return sorted(d for d in days if any(f.isFile() for f in self._status(f"{name}/date={d}") or []))

    def has_day(self, day: str) -> bool:
        files = self._status(f"prices/date={day}") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) else None
        return any(f.isFile() for f in files or [])

    def load_prices(self) -> DataFrame:
        if not self.stored_days():
            return self.spark.createDataFrame([], PRICES)
        order = [c.split()[0] for c in PRICES.split(", ")]
        return self.spark.read.schema(PRICES).parquet(f"{self.root}/prices").select(order)

    def load_day(self, day: str) -> DataFrame:
        return self.load_prices().where(F.col("date") == F.lit(day).cast("date"))

    def load_products(self) -> DataFrame:
        return self.spark.read.schema(PRODUCTS).parquet(f"{self.root}/products")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/{name}")

    def write_prices(self, df: DataFrame) -> None:
        self._write(df, "prices")

    def write_quarantine(self, df: DataFrame) -> None:
        self._write(df, "quarantine")  # of no rows it makes no partition

    def write_products(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/products")

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the views ``prices`` and ``products``."""
        if not self.stored_days():
            raise FileNotFoundError(f"no prices under {self.root}")
        self.load_prices().createOrReplaceTempView("prices")
        if self._status("products") is not None:
            self.load_products().createOrReplaceTempView("products")
        return self.spark.sql(sql)

    def fingerprint(self) -> DataFrame:
        """first, last and n of the stored prices."""
        if not self.stored_days():
            raise FileNotFoundError(f"no prices under {self.root}")
        return self.load_prices().agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))
