"""Geocode enrichment against a keyed cache (I8: B20, B21, C5–C8, H21, H22, G4, A9, D21).

No network calls happen here: resolving an address means joining its
cache key against the ``geocode_cache`` table ``(addr_key, latitude,
longitude, found)``.  ``found = false`` is a *negative* entry (looked up
before, no result).  Addresses with no entry on any tier form the work
list for an external geocoder; its answers come back as a table and are
merged into the cache (``merge_cache``).

Each unique address is resolved once (``distinct`` on the address, then
a join back to every contact row — C6), so duplicated addresses cost one
look-up.  Fallback tiers are exploded as rows with their ordinal and the
best hit per address is ``min_by(…, tier)`` — no driver-side loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.text import address_key

# FIXED VALUES: the address clean-up of the second tier and the unit
# pattern stripped by the third tier.
TIER1_REPLACEMENTS = [("#", ""), ("Ste", "Suite"), ("Apt", "Apartment")]
UNIT_PATTERN = r"(?i)\b(Suite|Ste|Apt|Apartment|#)\s*\w*\b"


def needs_geocoding(contacts: DataFrame, address: str, lat: str, lon: str) -> DataFrame:
    """Distinct rows with an address and a missing coordinate."""
    return (contacts.dropDuplicates()
            .filter(F.col(address).isNotNull() & (F.col(lat).isNull() | F.col(lon).isNull())))


def address_tiers(addr: Column) -> Column:
    """``array<struct<tier, candidate>>`` — original, cleaned (if changed), unit-stripped (if changed, > 10 chars)."""
    cleaned = addr
    for a, b in TIER1_REPLACEMENTS:
        cleaned = F.replace(cleaned, F.lit(a), F.lit(b))
    stripped = F.trim(F.regexp_replace(addr, UNIT_PATTERN, ""))
    t0 = F.struct(F.lit(0).alias("tier"), addr.alias("candidate"))
    t1 = F.when(cleaned != addr, F.struct(F.lit(1).alias("tier"), cleaned.alias("candidate")))
    t2 = F.when((stripped != addr) & (F.length(stripped) > 10), F.struct(F.lit(2).alias("tier"), stripped.alias("candidate")))
    return F.filter(F.array(t0, t1, t2), lambda x: x.isNotNull())


def resolve_addresses(addresses: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """C5 + H21 + H22: one row per distinct address with the first tier that the cache resolves.

    ``status`` is ``hit`` (coordinates found), ``negative`` (every known
    tier is a negative entry) or ``unresolved`` (some tier never looked up
    → goes to the work list).
    """
    uniq = addresses.select(F.col(address).alias("address")).filter(F.col("address").isNotNull()).distinct()
    tiers = uniq.select("address", F.inline(address_tiers(F.col("address"))))
    keyed = tiers.withColumn("addr_key", address_key(F.col("candidate"))).filter(F.col("addr_key").isNotNull())
    c = cache.select("addr_key", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "found")
    j = keyed.join(c, "addr_key", "left")
    hit = F.col("found") & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    best = j.groupBy("address").agg(
        F.min_by(F.struct("_lat", "_lon", "tier"), F.when(hit, F.col("tier"))).alias("_best"),
        F.max(F.col("found").isNull().cast("int")).alias("_unknown"),
    )
    return best.select(
        "address",
        F.col("_best._lat").alias("latitude"),
        F.col("_best._lon").alias("longitude"),
        F.col("_best.tier").alias("tier"),
        F.when(F.col("_best").isNotNull(), F.lit("hit"))
         .when(F.col("_unknown") == 1, F.lit("unresolved")).otherwise(F.lit("negative")).alias("status"),
    )


def enrich_contacts(contacts: DataFrame, cache: DataFrame, address: str, lat: str, lon: str) -> DataFrame:
    """C6 + C7: fill missing coordinates on every row whose address the cache resolves."""
    todo = needs_geocoding(contacts, address, lat, lon)
    return fill_coordinates(todo, resolve_addresses(todo, cache, address), address, lat, lon)


def fill_coordinates(todo: DataFrame, resolved: DataFrame, address: str, lat: str, lon: str) -> DataFrame:
    """Every row of an address gets what the address was resolved to, once."""
    r = resolved.select(F.col("address").alias("_addr"), F.col("latitude").alias("_glat"),
                        F.col("longitude").alias("_glon"), "tier", "status")
    j = todo.join(r, todo[address] == r["_addr"], "left")
    return (j.withColumn(lat, F.coalesce(F.col(lat), F.col("_glat")))
             .withColumn(lon, F.coalesce(F.col(lon), F.col("_glon")))
             .drop("_addr", "_glat", "_glon"))


def work_list(resolved: DataFrame) -> DataFrame:
    """Addresses still to send to the external geocoder (no entry on some tier, no hit)."""
    return resolved.filter(F.col("status") == "unresolved").select("address")


def split_results(geocoded: DataFrame, lat: str, lon: str, name: str, address: str) -> tuple[DataFrame, DataFrame]:
    """Successes; failures projected to distinct (name, address)."""
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return geocoded.filter(ok), geocoded.filter(~ok).select(name, address).distinct()


def geocode_report(geocoded: DataFrame, lat: str, lon: str) -> DataFrame:
    """Totals, successes, failures, success %."""
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    n = F.count(F.lit(1))
    return geocoded.agg(n.alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
                        F.when(n > 0, F.round(F.count_if(ok) / n * 100, 1)).alias("success_pct"))


def merge_results(successes: DataFrame, retries: DataFrame) -> DataFrame:
    """Successes UNION ALL retries, then distinct."""
    return successes.unionByName(retries, allowMissingColumns=True).distinct()


def merge_cache(cache: DataFrame, new_entries: DataFrame) -> DataFrame:
    """Union old and new entries (hits and misses), newest per key wins (as a table; ``update_cache`` stores it)."""
    from provena.operators.dedup import keep_first
    allc = cache.unionByName(new_entries, allowMissingColumns=True)
    return keep_first(allc, ["addr_key"], [F.col("looked_up_at").desc_nulls_last()])


CACHE_SCHEMA = "addr_key string, latitude double, longitude double, address string, found boolean, looked_up_at timestamp_ntz, prefix string"
#: Hex digits of the key that name a cache partition: 256 parts of equal size, as keys are digests.
PREFIX_DIGITS = 2


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    from provena.sources.keyed import read_keyed
    return read_keyed(spark, path, T.StructType.fromDDL(CACHE_SCHEMA)).drop("prefix")


def update_cache(path: str, new_entries: DataFrame) -> None:
    """Merge new entries (hits and misses) into the stored cache; the newest per key stays, the old one on a tie.

    Only partitions that hold a new entry's key are read and rewritten, and only once the merged rows are complete.
    """
    from provena.sources.keyed import upsert
    columns = [f.name for f in T.StructType.fromDDL(CACHE_SCHEMA)][:-1]
    keyed = new_entries.filter(F.col("addr_key").isNotNull()).select(*columns)
    upsert(path, keyed.withColumn("prefix", F.substring("addr_key", 1, PREFIX_DIGITS)), ["addr_key"], "prefix",
           [F.col("looked_up_at").desc_nulls_last(), F.col("_old").desc()])


def cache_entries(answers: DataFrame, address: str = "address") -> DataFrame:
    """An external geocoder's answers ``(address, latitude, longitude, looked_up_at)`` as cache entries; no coordinates: a negative one."""
    found = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return answers.select(address_key(F.col(address)).alias("addr_key"), "latitude", "longitude", F.col(address).alias("address"),
                          found.alias("found"), "looked_up_at")


RESULT = ["full_name", "person_id", "latitude", "longitude"]


class GeocodeRun:
    """I8 from the contact list to its tables: a first pass on the addresses as they are, a retry on their fallback
    tiers, and what is left for an external geocoder."""

    def __init__(self, contacts: DataFrame, cache: DataFrame, address: str = "address", lat: str = "latitude", lon: str = "longitude",
                 name: str = "full_name", person_id: str = "person_id"):
        self.todo = needs_geocoding(contacts, address, lat, lon)
        self.resolved = resolve_addresses(self.todo, cache, address)
        first = fill_coordinates(self.todo, self.resolved.filter(F.col("tier") == 0), address, lat, lon)
        succeeded, self.failures = split_results(first, lat, lon, name, address)
        self.successes = succeeded.select(F.col(name).alias("full_name"), F.col(person_id).alias("person_id"),
                                          F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
        retried = self.resolved.filter((F.col("status") == "hit") & (F.col("tier") > 0))
        self.retries = retry_join(self.todo, retried, address, name, person_id)
        self.merged = merge_results(self.successes, self.retries)
        self.results = fill_coordinates(self.todo, self.resolved, address, lat, lon)
        self.work_list = work_list(self.resolved)

    def write(self, out: str) -> dict[str, str]:
        """The merged successes, all rows with their outcome, the failures of the first pass and the work list, each a table."""
        from provena.sources.io import write_table
        paths = {}
        for table, df in (("geocoded", self.merged), ("all_results", self.results), ("failures", self.failures), ("work_list", self.work_list)):
            paths[table] = f"{out.rstrip('/')}/{table}"
            write_table(df, paths[table])
        return paths


def retry_join(contacts: DataFrame, retries: DataFrame, address: str, name: str, person_id: str) -> DataFrame:
    """Contacts RIGHT JOIN retry results on the address; four columns kept."""
    r = retries.select(F.col("address").alias("_r_addr"), F.col("latitude").alias("latitude"),
                       F.col("longitude").alias("longitude"))
    c = contacts.select(F.col(address).alias("_c_addr"), F.col(name).alias("full_name"), F.col(person_id).alias("person_id"))
    return c.join(r, c["_c_addr"] == r["_r_addr"], "right").select("full_name", "person_id", "latitude", "longitude")
