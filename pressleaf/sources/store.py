"""An asset table in a folder: every put adds rows, and the last one of an address wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressleaf.operators.bundle import last_assets

COLUMNS = ("url_key", "final_url", "media_type", "charset", "data")


class AssetStore:
    def __init__(self, spark: SparkSession, path: str):
        """Opens the store, which need not be there yet. One writer at a time."""
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _puts(self) -> int:
        if not self._files.exists(self._place):
            return 0
        names = [x.getPath().getName() for x in self._files.listStatus(self._place)]
        return max((int(n.removeprefix("seq=")) + 1 for n in names if n.startswith("seq=")), default=0)

    def put(self, assets: DataFrame) -> None:
        """Adds rows of url_key, final_url, media_type, charset and data; a part of a put that fails is never read."""
        assets.select(*COLUMNS).write.parquet(f"{self.path}/seq={self._puts():08d}")

    def rows(self) -> DataFrame:
        """Every row that was put, with the put's number (seq)."""
        if not self._puts():
            return self.spark.createDataFrame([], "url_key string, final_url string, media_type string, charset string, data binary, seq int")
        return self.spark.read.option("basePath", self.path).parquet(self.path).select(*COLUMNS, F.col("seq").cast("int").alias("seq"))

    def get(self) -> DataFrame:
        """The store as an asset table, the last row of each address."""
        return last_assets(self.rows()).select("url_key", "a.final_url", "a.media_type", "a.charset", "a.data")

    def contains(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (url_key) that the store has."""
        return keys.join(self.rows().select("url_key").distinct(), "url_key", "left_semi")

    def shred(self) -> None:
        """Overwrites the store's files with zeros where its file system can, and removes them."""
        files = self._files.listFiles(self._place, True) if self._files.exists(self._place) else None
        zeros = bytes(100 << 10)
        while files is not None and files.hasNext():
            entry = files.next()
            out, left = self._files.create(entry.getPath(), True), entry.getLen()
            while left > 0:
                out.write(zeros[: min(left, len(zeros))])
                left -= len(zeros)
            out.close()
        self._files.delete(self._place, True)
