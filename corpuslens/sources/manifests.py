"""Numbered manifests: small text files that name the parts of each version of a folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Versioned:
    """A folder whose versions are committed by creating their manifest, by Hadoop's file systems on the driver."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 of a store that nothing was appended to."""
        files, folder = self._files(), self._path("manifests")
        if not files.exists(folder):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of a version (default: the last)."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._files().open(self._path(f"manifests/{version:010d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)["parts"]

    def _committed(self, version: int, parts: list[str]) -> bool:
        """Create a manifest; False if there is one of that number."""
        jvm = self.spark.sparkContext._jvm
        try:
            stream = self._files().create(self._path(f"manifests/{version:010d}.json"), False)
        except Exception as problem:
            if "FileAlreadyExists" in str(problem) or "already exists" in str(problem):
                return False
            raise
        jvm.org.apache.commons.io.IOUtils.write(json.dumps({"version": version, "parts": parts}), stream, "UTF-8")
        stream.close()
        return True
