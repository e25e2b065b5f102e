"""Answers of requests kept for reuse: in memory with a size and an age, or as tables that outlive the session."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict

from pyspark.sql import SparkSession

from graphloom.operators import relation as R
from graphloom.sources.views import Member


class RequestCache:
    """Least recently used entries go first; entries older than max_age seconds are not used."""

    def __init__(self, size: int = 100, max_age: float | None = 600.0, clock=time.monotonic):
        self.size, self.max_age, self.clock = size, max_age, clock
        self.entries: OrderedDict = OrderedDict()

    def get(self, key, make):
        if key in self.entries:
            at, value = self.entries[key]
            if self.max_age is None or self.clock() - at <= self.max_age:
                self.entries.move_to_end(key)
                return value
            self._drop(key)
        value = make()
        self.entries[key] = (self.clock(), value)
        while len(self.entries) > self.size:
            self._drop(next(iter(self.entries)))
        return value

    def _drop(self, key) -> None:
        _, value = self.entries.pop(key)
        if isinstance(value, R.Rel):
            value.df.unpersist()


class CachedMember(Member):
    """A member whose answers are persisted by Spark for as long as the cache keeps them."""

    def __init__(self, inner: Member, cache: RequestCache):
        super().__init__(inner.views, inner.vocabulary)
        self.inner, self.cache, self.single = inner, cache, inner.single

    def evaluate(self, spark: SparkSession, triples):
        def make() -> R.Rel:
            rel = self.inner.evaluate(spark, triples)
            return R.Rel(rel.df.persist(), rel.descs, rel.certain)

        return self.cache.get((id(self.inner), triples), make)


class StoredMember(Member):
    """A member whose answers are written as tables to a folder, and read from there by later sessions too."""

    def __init__(self, inner: Member, folder: str, name: str):
        super().__init__(inner.views, inner.vocabulary)
        self.inner, self.folder, self.name, self.single = inner, folder.rstrip("/"), name, inner.single

    def evaluate(self, spark: SparkSession, triples):
        rel = self.inner.evaluate(spark, triples)
        digest = hashlib.sha256(repr((self.name, triples)).encode()).hexdigest()
        path = f"{self.folder}/{digest}"
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            rel.df.write.mode("overwrite").parquet(path)
        return R.Rel(spark.read.schema(rel.df.schema).parquet(path), rel.descs, rel.certain)
