"""Where a run's inputs and results lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Layout:
    """Folders under a root, which may be in any store that Spark reaches."""

    root: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "root", self.root.rstrip("/"))

    def under(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    @property
    def data(self) -> str:
        return self.under("data")

    @property
    def results(self) -> str:
        return self.under("results")

    @property
    def figures(self) -> str:
        return self.under("results", "figures")

    @property
    def processed(self) -> str:
        return self.under("results", "processed")

    @property
    def reports(self) -> str:
        return self.under("results", "reports")

    def prepare(self, spark: SparkSession) -> "Layout":
        """Makes the folders that are missing."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in (self.data, self.figures, self.processed, self.reports):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).mkdirs(path)
        return self
