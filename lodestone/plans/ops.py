"""Cache keys and tables, audit log, and a check of the installation."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import platform
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that entries of a layer live.
TTL = {"embedding": 86_400, "query_extension": 1_800, "search": 300, "rerank": 3_600}


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]


def embedding_key(model: str, text: str) -> str:
    return f"emb:{_digest([model, text])}"


def extension_key(model: str, query: str, options: dict | None = None) -> str:
    return f"qext:{_digest([model, query, options or {}])}"


def search_key(dataset_ids: Sequence[str], versions: dict[str, int], query: str, **settings) -> str:
    """All settings that change a result belong to the key, and the version of each dataset."""
    return f"search:{'-'.join(sorted(dataset_ids))}:{_digest([sorted(versions.items()), query, settings])}"


def rerank_key(model: str, query: str, chunk_ids: Sequence[str]) -> str:
    return f"rk:{_digest([model, query, list(chunk_ids)])}"


def version_key(dataset_id: str) -> str:
    return f"version:{dataset_id}"


def key_column(prefix: str, *parts: Column | str) -> Column:
    """The same idea for whole tables; spacing of the JSON differs from the functions above."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256), 1, 32))


def cache_entries(rows: DataFrame, layer: str, key: Column, now: Column | None = None) -> DataFrame:
    if layer not in TTL:
        raise ValueError(f"unknown layer {layer}")
    now = now if now is not None else F.current_timestamp()
    return rows.withColumn("cache_key", key).withColumn("expires_at", (now.cast("timestamp").cast("long") + TTL[layer]).cast("timestamp"))


def live_entries(entries: DataFrame, versions: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Entries that have not expired and, with ``versions(dataset_id, version)``, belong to the current version."""
    out = entries.filter(F.col("expires_at") > (now if now is not None else F.current_timestamp()))
    return out if versions is None else out.join(versions, ["dataset_id", "version"], "left_semi")


def invalidate(versions: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """The next version of one dataset, or of all: entries of the old one no longer live."""
    hit = F.lit(True) if dataset_id is None else F.col("dataset_id") == dataset_id
    return versions.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))


class Cache:
    """Entries of a layer in a table ``cache_<layer>`` of a warehouse, with counts of hits, misses and failures.

    A cache never fails a request: what cannot be read is a miss, what cannot be
    written is not there, and both count as unavailable.
    """

    def __init__(self, warehouse, layer: str, now: Column | None = None):
        self.warehouse, self.layer, self.now = warehouse, layer, now
        self.counts = {"hit": 0, "miss": 0, "unavailable": 0}

    def _entries(self) -> DataFrame | None:
        name = f"cache_{self.layer}"
        return self.warehouse.read(name) if self.warehouse.version(name) else None

    def get(self, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """``keys`` with the other columns of their live entries, None without a table of entries, and the keys that have none."""
        try:
            entries, found, missed = self._entries(), None, keys
            if entries is not None:
                live = live_entries(entries, None, self.now).drop("expires_at")
                found, missed = keys.join(live, "cache_key"), keys.join(live.select("cache_key"), "cache_key", "left_anti")
            hit, miss = 0 if found is None else found.count(), missed.count()
        except Exception:  # a cache that is away costs its gain alone
            self.counts["unavailable"] += 1
            return None, keys
        self.counts["hit"] += hit
        self.counts["miss"] += miss
        return found, missed

    def put(self, rows: DataFrame) -> None:
        """Adds the rows, which hold ``cache_key``; entries of the same key and dead ones go."""
        try:
            fresh = cache_entries(rows.dropDuplicates(["cache_key"]), self.layer, F.col("cache_key"), self.now)
            entries = self._entries()
            if entries is not None:
                fresh = fresh.unionByName(live_entries(entries, None, self.now).join(fresh.select("cache_key"), "cache_key", "left_anti"))
            self.warehouse.commit(f"cache_{self.layer}", fresh)
        except Exception:  # the request has its result already
            self.counts["unavailable"] += 1


def audit_records(results: DataFrame, now: Column | None = None) -> DataFrame:
    """Counts and lengths of searches, no contents."""
    return results.select(
        (now if now is not None else F.current_timestamp()).alias("at"),
        F.col("query_id").cast("string").alias("request_id"),
        F.size("dataset_ids").alias("n_datasets"),
        F.length("query").alias("query_chars"),
        "n_citations",
        F.length("response").alias("response_chars"),
        "valid",
        F.size("out_of_range_ids").alias("n_out_of_range"),
        F.size("orphan_indices").alias("n_orphans"),
    )


def write_audit(results: DataFrame, path: str, share: float = 1.0, seed: int = 7) -> bool:
    """Appends a sample of the audit rows as JSON lines; a failure is reported and never raised."""
    try:
        rows = audit_records(results)
        (rows if share >= 1 else rows.sample(False, max(0.0, share), seed)).write.mode("append").json(path)
        return True
    except Exception:  # an audit that fails must not fail the search
        return False


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def doctor(spark: SparkSession) -> DataFrame:
    """``(check, status, detail)`` of the session and of optional libraries."""
    rows = [("python", "pass", platform.python_version()), ("spark", "pass", spark.version)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows.append(("time zone", "pass" if zone == "UTC" else "warn", zone))
    rows.append(("adaptive execution", "pass" if spark.conf.get("spark.sql.adaptive.enabled") == "true" else "warn", spark.conf.get("spark.sql.adaptive.enabled")))
    rows.append(("shared folder", "pass" if spark.conf.get("spark.checkpoint.dir", None) else "warn", spark.conf.get("spark.checkpoint.dir", None) or "unset: a local one is used"))
    rows += [(n, "pass" if importlib.util.find_spec(n) else "fail", "") for n in ("numpy", "pyarrow", "xxhash")]
    return spark.createDataFrame(rows, "check string, status string, detail string")
