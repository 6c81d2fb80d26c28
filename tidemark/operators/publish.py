"""Versions of a snapshot: write once, found by a build key, switched by one small write, pruned by retention."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X


def build_key(spark: SparkSession, records: DataFrame, versions: dict) -> str:
    """A key of the inputs' content and of the versions that shape the result, from one sum over row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}))
    n, total, mixed = records.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return hashlib.sha256(json.dumps([n, str(total), mixed, versions], sort_keys=True).encode()).hexdigest()


def input_key(spark: SparkSession, paths: list[str], versions: dict) -> str:
    """A key of input files as they stand (path, length, time of change) and of the versions that shape the result. It
    reads no data: files that are written once and never changed in place have one content."""
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), versions], sort_keys=True).encode()).hexdigest()


# Fixed value: the name space of revision ids.
REVISIONS = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def staged_inputs(records: DataFrame) -> DataFrame:
    """domain, event_id, content_hash, embedding_hash, input_hash, revision_id of records: what a build freezes.

    The content hash covers title, summary, type, direction, days, precision, entities, relations and evidence, and no
    wording of the vector; the embedding hash the vector to six digits; the input hash both; the revision id is named by
    domain, event and content, so the same content keeps its revision. Null reads as empty, and so does a number that is not
    finite or beyond a billion."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nested = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("\u001e", *[F.coalesce(x[f], F.lit("")) for f in fields])), "\u001d"), F.lit(""))
    parts = [text(c) for c in ("title", "summary", "event_type", "direction", "start_day", "end_day", "time_precision")]
    parts += [nested("entities", "entity_type", "key", "name", "role"), nested("relations", "relation_type", "source_claim", "target_claim", "evidence_text"), nested("evidence", "video_id", "evidence_text")]
    vector = F.array_join(F.transform("vector", lambda x: F.coalesce(F.when((x < 1e9) & (x > -1e9), F.floor(x.cast("double") * 1_000_000)).cast("string"), F.lit(""))), ",")
    h = records.select("domain", "event_id", F.sha2(F.concat_ws("\u001f", *parts), 256).alias("content_hash"), F.sha2(F.coalesce(vector, F.lit("")), 256).alias("embedding_hash"))
    whole = F.sha2(F.concat_ws("|", "event_id", "content_hash", "embedding_hash"), 256)
    return h.withColumns({"input_hash": whole, "revision_id": X.uuid5(REVISIONS, F.concat_ws(":", "domain", "event_id", "content_hash"))})


def fingerprints(staged: DataFrame) -> DataFrame:
    """domain, records, fingerprint: a hash of the input hashes in the order of event ids. A domain's list is 64 bytes a
    record in one row."""
    order = F.array_sort(F.collect_list(F.struct("event_id", "input_hash")))
    return staged.groupBy("domain").agg(F.count("*").alias("records"), F.sha2(F.array_join(F.transform(order, lambda x: x["input_hash"]), ","), 256).alias("fingerprint"))


class Publisher:
    """Snapshots below a folder: one folder a version, and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write_text(self, name: str, text: str) -> None:
        """To a name of its own first, then renamed, so that readers see the old or the new text."""
        part = self._path(f".{name.replace('/', '_')}.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(name), False)
        self._fs.rename(part, self._path(name))

    def _read_text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def find(self, key: str) -> str | None:
        """The complete version of a build key, if there is one."""
        return self._read_text(f"keys/{key}")

    def publish(self, key: str, tables: dict[str, DataFrame]) -> tuple[str, bool]:
        """The version of a build key and whether it was reused. A version shows only once all its tables are there."""
        if (have := self.find(key)) is not None:
            self._write_text("CURRENT", have)
            return have, True
        version = f"v-{key[:16]}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        self._fs.mkdirs(self._path("keys"))
        self._write_text(f"keys/{key}", version)
        self._write_text("CURRENT", version)
        return version, False

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of the current version, or of exactly the version asked for: never of another in its place."""
        at = version or self._read_text("CURRENT")
        if at is None or not self._fs.exists(self._path(f"{at}/{table}")):
            raise LookupError(f"version {version or 'CURRENT'} has no table {table}")
        return self.spark.read.parquet(f"{self.root}/{at}/{table}")
