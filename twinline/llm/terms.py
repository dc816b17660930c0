"""Problem 3: occurrences and record counts of every term, kept up to date by signed deltas.

The counts live in segments, tables partitioned by field and hash bucket of the term. An update reads only the changed
records: every version of a record that goes counts -1, every one that comes +1. The deltas are added up per term and
written as one more segment; nothing else is rewritten. When deltas have grown to half of the base, or are too many
files to read, all segments are merged into a new base, with as many buckets as its size asks for.

Every change is published as a manifest with the next number, which takes its name in one rename and is never written
again: a reader or a crash at any moment sees the old state or the new one, and of two writers one fails. Segments that
the last KEEP manifests name stay, so that running readers find their files. A manifest also holds the last batch
number of each source; an update with a number not beyond it was taken in before and is skipped, so that a batch can
be tried again.

Null values are no records of their field; a text without terms is one. Repeated rows count as often as they occur,
other columns play no part, and an empty table changes nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a term of a text is made of, and the letters whose case is folded.
TERM = "[A-Za-z0-9_]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE_ROWS = 3
COMMON_PERCENT = 10
TOTAL = "total"  # field of the rows that hold each field's number of records
STATE = "field_name string, term string, n_occurrences long, n_rows long"


def text_terms(text: Column) -> Column:
    """Each occurrence of a term."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def field_deltas(rows: DataFrame, texts: list[str], values: list[str], sign: Column) -> DataFrame:
    """Signed occurrences and records per field and term, and each field's signed number of records.

    texts are split into terms, a value is one term as a whole. A row gives each field's terms once with all
    occurrences and once without repetitions; all of it is generated code, and summed up before the shuffle.
    """
    found = rows.select(sign.alias("s"), *(F.col(c).alias(f"v_{c}") for c in texts + values), *(text_terms(F.col(c)).alias(f"t_{c}") for c in texts))

    def part(field: str, terms: Column, o: int, r: int) -> Column:
        return F.struct(F.lit(field).alias("field_name"), terms.alias("terms"), F.lit(o).alias("o"), F.lit(r).alias("r"))

    parts = [part(c, F.col(f"t_{c}"), 1, 0) for c in texts] + [part(c, F.array_distinct(f"t_{c}"), 0, 1) for c in texts]
    parts += [part(c, F.when(F.col(f"v_{c}").isNotNull(), F.array(f"v_{c}")), 1, 1) for c in values]
    parts += [part(TOTAL, F.when(F.col(f"v_{c}").isNotNull(), F.array(F.lit(c))), 1, 1) for c in texts + values]
    each = found.select("s", F.inline(F.array(*parts))).select("s", "field_name", "o", "r", F.explode("terms").alias("term"))
    sums = each.groupBy("field_name", "term").agg(F.sum(F.col("s") * F.col("o")).alias("n_occurrences"), F.sum(F.col("s") * F.col("r")).alias("n_rows"))
    return sums.filter("n_occurrences <> 0 OR n_rows <> 0")


BUCKET_ROWS = 1_000_000
MOST_SEGMENTS = 8
KEEP = 3


class TermCounts:
    """Persistent counts below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, texts: list[str], values: list[str], bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.texts, self.values, self.bucket_rows = spark, path, texts, values, bucket_rows

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """The numbers of the manifests, rising."""
        fs, path = self._fs()
        folder = path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or an earlier one."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": 1, "segments": [], "batches": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version or known[-1]:012d}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest aside and gives it the next number; fails if another writer was first."""
        fs, path = self._fs()
        aside, name = path(f"{self.path}/aside-{uuid.uuid4().hex}"), path(f"{self.path}/manifests/{manifest['version']:012d}")
        fs.mkdirs(name.getParent())
        out = fs.create(aside)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(aside, name):
            fs.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} was published by another writer")
        self._clear()

    def _clear(self) -> None:
        """Removes manifests before the last KEEP, and the segments that only they name."""
        fs, path = self._fs()
        known = self.versions()
        kept = {s["folder"] for v in known[-KEEP:] for s in self.manifest(v)["segments"]}
        for v in known[:-KEEP]:
            for s in self.manifest(v)["segments"]:
                if s["folder"] not in kept:
                    fs.delete(path(f"{self.path}/{s['folder']}"), True)
            fs.delete(path(f"{self.path}/manifests/{v:012d}"), False)

    def _write(self, counts: DataFrame, buckets: int) -> dict:
        folder = f"segment-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("field_name", "term"), F.lit(buckets)).cast("int")
        placed = counts.withColumn("bucket", bucket)
        if buckets > 1:
            placed = placed.repartition(buckets, "bucket")
        placed.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return {"folder": folder, "rows": self._segment(folder).count()}

    def _segment(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{STATE}, bucket int").parquet(f"{self.path}/{folder}").select("field_name", "term", "n_occurrences", "n_rows")

    def read(self, version: int | None = None) -> DataFrame:
        """The counts, of the newest state or of an earlier one that is still kept."""
        return self._merged(self.manifest(version)["segments"])

    def _merged(self, segments: list[dict]) -> DataFrame:
        parts = [self._segment(s["folder"]) for s in segments if s["rows"]]
        if not parts:
            return self.spark.createDataFrame([], STATE)
        if len(parts) == 1:
            return parts[0]
        sums = reduce(DataFrame.unionByName, parts).groupBy("field_name", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_rows").alias("n_rows"))
        return sums.filter("n_rows <> 0 OR n_occurrences <> 0")

    def update(self, added: DataFrame | None = None, deleted: DataFrame | None = None, source: str = "", batch: int | None = None) -> bool:
        """Takes in added and deleted records; a changed one is given in both, in its new and its old version.

        batch numbers the updates of a source, rising. False if the batch had been taken in before.
        """
        signed = [x.select(*self.texts, *self.values, F.lit(s).cast("long").alias("__sign")) for x, s in ((added, 1), (deleted, -1)) if x is not None]
        if not signed and batch is None:
            return True
        now = self.manifest()
        if batch is not None and batch <= now["batches"].get(source, -1):
            return False
        segments = now["segments"]
        if signed:
            deltas = field_deltas(reduce(DataFrame.unionByName, signed), self.texts, self.values, F.col("__sign"))
            segments = [*segments, self._write(deltas, now["buckets"])]
        batches = now["batches"] | ({} if batch is None else {source: batch})
        self._publish({"version": now["version"] + 1, "buckets": now["buckets"], "segments": segments, "batches": batches})
        base, *later = segments or [{"rows": 0}]
        outgrown = base["rows"] > 2 * now["buckets"] * self.bucket_rows
        if outgrown or len(later) >= MOST_SEGMENTS or 2 * sum(s["rows"] for s in later) > base["rows"] > 0:
            self.compact()
        return True

    def compact(self) -> None:
        """Merges all segments into one, and finds the number of buckets anew."""
        now = self.manifest()
        buckets = max(1, -(-max(s["rows"] for s in now["segments"]) // self.bucket_rows))
        merged = self._write(self._merged(now["segments"]), buckets)
        self._publish({"version": now["version"] + 1, "buckets": buckets, "segments": [merged], "batches": now["batches"]})

    def terms(self) -> DataFrame:
        """field_name, term, n_occurrences, n_rows and mark (too_rare, too_common or null) of every term."""
        state = self.read()
        totals = F.broadcast(state.filter(F.col("field_name") == TOTAL).select(F.col("term").alias("field_name"), F.col("n_rows").alias("all_rows")))  # a row a field
        mark = F.when(F.col("n_rows") < RARE_ROWS, "too_rare").when(F.col("n_rows") * 100 > F.col("all_rows") * COMMON_PERCENT, "too_common")
        return state.join(totals, "field_name").select("field_name", "term", "n_occurrences", "n_rows", mark.alias("mark"))
