"""Registered queries over the driver tables (the Spark side of the contract).

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the *whole* tables.  Fixed parameters live in ``pipeline``; doubles are
rounded to 6 places in the final projection so the DuckDB oracle compares
exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text
from provena.operators import geocode, overlay, preferred, preparation, quality, recommend, referrals as R, rollup, sketches, spatial
from provena.plans import datasets, pipeline as P
from provena.session import checkpoint_dir
from provena.sources import io, layout, snapshots, testdata as td
from provena.streaming import intake

AS_OF = "2002-06-30 00:00:00"
W0, W1 = P.WINDOW
PAIR_RADIUS = 400.0
ISSUE_CHECKS = [("full_name", "Missing Full Name"), ("work_address", "Missing Work Address"),
                ("work_phone", "Missing Work Phone"), ("latitude", "Missing Latitude"), ("longitude", "Missing Longitude")]


def _r(c: str, nd: int = 6):
    return F.round(F.col(c), nd).alias(c)


def _new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own for what a query stores, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _rec_out(df: DataFrame, *lead: str) -> DataFrame:
    return df.select(*lead, "full_name", _r("distance_miles"), "referral_count", "inbound_referral_count", "preferred",
                     _r("norm_dist"), _r("norm_rank"), _r("norm_inbound"), _r("score"),
                     F.col("rank").cast("int").alias("rank"))


# --- ETL, roll-up, enrichment -------------------------------------------------
def referrals_etl(spark, sf):
    return P.cleaned_referrals(spark, sf).drop("_seq")


def preparation_summary(spark, sf):
    return R.preparation_summary(P.cleaned_referrals(spark, sf))


def preparation_run(spark, sf):
    """The summary observed while the cleaned referrals are written."""
    return preparation.prepare(td.raw_export(spark, sf), f"{_new_folder(spark, 'prepared')}/referrals")


def overlay_all_referrals(spark, sf):
    """The export's rows, one per party, with all their other columns (its referred-to headers without their prefix)."""
    raw = td.raw_export(spark, sf)
    named = raw.withColumnsRenamed({c: c.removeprefix("Dr/Facility ") for c in raw.columns})
    columns = {"project_id": "Project ID", "referral_type": "referral_type", "full_name": "Full Name", "work_phone": "Work Phone",
               "work_address": "Work Address", "latitude": "Latitude", "longitude": "Longitude", "last_verified_date": "Last Verified Date",
               "referral_date": "Referral Date", "referral_source": "Referral Source", "secondary_person_id": "Secondary Referred From's Details: Person ID",
               "referred_to": "Referred To Full Name"}
    return overlay.overlay_all(named).select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def dataset_dispatch(spark, sf):
    """Every dataset loaded from the export, from an export that is clean already, and without one."""
    base = _new_folder(spark, "datasets")
    raw, preferred_raw = td.raw_export(spark, sf), td.preferred_export(spark, sf)
    cleaned, of_referrals = f"{base}/cleaned", [d for d in datasets.DATASETS if d != datasets.PREFERRED]
    exported = datasets.load_datasets(spark, of_referrals, lambda: raw, cleaned)
    exported[datasets.PREFERRED] = datasets.load_dataset(spark, datasets.PREFERRED, lambda: preferred_raw, cleaned)
    datasets.save_cleaned(exported[datasets.ALL], exported[datasets.PREFERRED], cleaned)
    out = None
    for name in datasets.DATASETS:
        kept = f"{cleaned}/{'preferred' if name == datasets.PREFERRED else 'referrals'}"
        ways = {"export": exported[name],
                "clean": datasets.load_dataset(spark, name, lambda: spark.read.parquet(kept), cleaned),
                "fallback": datasets.load_dataset(spark, name, lambda: spark.read.parquet(f"{base}/no-such-export"), cleaned)}
        for way, rows in ways.items():
            one = rows.agg(F.lit(name).alias("dataset"), F.lit(way).alias("way"), F.count(F.lit(1)).alias("row_count"),
                           F.count_distinct("full_name").alias("names"))
            out = one if out is None else out.unionByName(one)
    return out


def sketch_report(spark, sf):
    """D17/D24 from sketches of monthly loads and approximate medians, held against the exact figures."""
    refs = P.Context(spark, sf).referrals_table
    approx = sketches.merged(sketches.load_sketches(refs, intake.month_of(F.col("date_of_intake"))))
    medians = sketches.approximate_statistics(refs).select("referral_type", F.col("median_per_provider").alias("_median"))
    exact = quality.referral_statistics(refs).select("referral_type", F.col("providers").alias("_exact"), "median_per_provider")
    return approx.join(medians, "referral_type").join(exact, "referral_type").select(
        "referral_type", "referrals", "first_intake", "last_intake", "loads",
        (F.abs(F.col("providers") / F.col("_exact") - 1) <= sketches.ERROR_BOUND).alias("names_within_bound"),
        (F.abs(F.col("_median") - F.col("median_per_provider")) <= 1).alias("median_within_bound"))


CLUSTER_RADIUS = 300.0


def clustered_window(spark, sf):
    """referrals of a window near the default client, read from files clustered by place and date."""
    path = f"{_new_folder(spark, 'clustered')}/referrals"
    # Cuts, ranges and rows are three readings: the export is cleaned and written once.
    io.write_clustered(P.Context(spark, sf).referrals_table, path, files=32)
    box = layout.in_box(P.CLIENT_LAT, P.CLIENT_LON, CLUSTER_RADIUS)
    near = recommend.filter_radius(recommend.with_distance(spark.read.parquet(path).filter(box), P.CLIENT_LAT, P.CLIENT_LON), CLUSTER_RADIUS)
    return rollup.window(near, W0, W1, "date_of_intake").groupBy("referral_type", "full_name").agg(F.count(F.lit(1)).alias("referrals"))


def provider_rollup(spark, sf):
    return P.providers(spark, sf)


def enriched_providers(spark, sf):
    return P.enriched_providers(spark, sf)


def inbound_counts(spark, sf):
    return rollup.largest_first(rollup.inbound_counts(P.Context(spark, sf).inbound), "inbound_referral_count")


def time_filtered_providers(spark, sf):
    return P.time_filtered_providers(spark, sf).select(
        "full_name", "referral_count", "inbound_referral_count", "preferred", "latitude", "longitude")


def time_based_counts(spark, sf):
    return rollup.largest_first(rollup.referral_counts(P.Context(spark, sf).outbound, W0, W1))


def raw_inbound_counts(spark, sf):
    return rollup.largest_first(rollup.raw_inbound_counts(P.Context(spark, sf).raw), "inbound_referral_count")


def unique_specialties(spark, sf):
    return rollup.unique_specialties(P.enriched_providers(spark, sf))


# --- preferred list -----------------------------------------------------------
def preferred_list(spark, sf):
    cleaned, _ = preferred.process_preferred(td.preferred_export(spark, sf))
    return cleaned.drop("_seq")


def preferred_missing_geo(spark, sf):
    _, missing = preferred.process_preferred(td.preferred_export(spark, sf))
    return missing.drop("_seq")


def preferred_summary(spark, sf):
    return preferred.preferred_summary(td.preferred_export(spark, sf))


# --- recommendation -----------------------------------------------------------
def recommend_top10(spark, sf):
    return _rec_out(P.recommendation(spark, sf, k=10))


def recommend_ranked(spark, sf):
    return _rec_out(P.recommendation(spark, sf))


def recommend_preferred(spark, sf):
    return _rec_out(P.recommendation(spark, sf, k=25, weights=P.PREF_WEIGHTS))


def recommend_specialty(spark, sf):
    return _rec_out(P.recommendation(spark, sf, specialties=["ECONOMY", "SMALL"]))


def best_provider(spark, sf):
    return _rec_out(P.recommendation(spark, sf, k=1))


def batch_top5(spark, sf):
    return _rec_out(P.batch_recommendation(spark, sf, k=5), "client_id")


def radius_pairs(spark, sf):
    # The radius join reads the providers in two branches (cell join + polar
    # row join), so it uses the table written once.
    cand = P.Context(spark, sf).enriched.filter(F.col("referral_count") >= P.MIN_REFERRALS)
    pairs = spatial.radius_pairs(td.clients(spark, sf), cand, PAIR_RADIUS)
    return pairs.select("client_id", "full_name", "inbound_referral_count", _r("distance_miles"))


def scenario_comparison(spark, sf):
    return _rec_out(P.scenario_comparison(spark, sf, k=10), "scenario")


# --- reports ------------------------------------------------------------------
def data_quality(spark, sf):
    return quality.data_quality(P.enriched_providers(spark, sf))


def integrity_report(spark, sf):
    ctx = P.Context(spark, sf)
    table = ctx.referrals_table  # read four times below: written once
    refs = table.drop("_seq")
    providers = rollup.provider_rollup(table.filter(F.col("referral_type") == "outbound"))
    return quality.validate_all({
        "inbound": (refs.filter(F.col("referral_type") == "inbound"), ["full_name", "project_id"]),
        "outbound": (refs.filter(F.col("referral_type") == "outbound"), ["full_name", "project_id"]),
        "all_referrals": (refs, ["full_name", "project_id"]),
        "provider": (providers, ["full_name", "referral_count"]),
        "preferred_providers": (ctx.preferred.drop("_seq"), ["full_name", "project_id"]),
    })


def source_validation(spark, sf):
    """D9 over files that aren't all sound: a CSV folder with one broken line, a table, and a folder that isn't there."""
    base = _new_folder(spark, "sources")
    contacts = td.contact_table(spark, sf)
    contacts.write.option("header", True).csv(f"{base}/contacts")
    broken = spark.range(1).select(F.explode(F.array(F.lit(",".join(contacts.columns)), F.lit("only,three,cells"))).alias("line"))
    broken.coalesce(1).write.mode("append").text(f"{base}/contacts")
    return preparation.validate_sources(spark, {
        "contacts": (lambda: io.load_table(spark, f"{base}/contacts", "csv", corrupt_col="_corrupt"), ["full_name", "address"]),
        "preferred_providers": (lambda: P.Context(spark, sf).preferred, ["full_name", "project_id"]),
        "archive": (lambda: io.load_table(spark, f"{base}/archive", "csv"), ["full_name"]),
    }).withColumn("error", F.col("error").isNotNull())


def providers_missing_geo(spark, sf):
    return quality.providers_missing_geo(P.providers(spark, sf)).select("full_name", "latitude", "longitude", "referral_count")


def audit_summary(spark, sf):
    return quality.audit_summary(address_audit(spark, sf))


def contact_phones(spark, sf):
    """H3: the contact list's phones with separators stripped, formatted where they have ten digits."""
    return td.contact_table(spark, sf).select("person_id", text.strip_phone("phone").alias("phone"))


def provider_validation(spark, sf):
    return quality.provider_validation(P.providers(spark, sf))


def us_bounds_audit(spark, sf):
    return quality.us_bounds_audit(P.enriched_providers(spark, sf))


def issue_records(spark, sf):
    refs = P.cleaned_referrals(spark, sf)
    return quality.issue_records(refs, ISSUE_CHECKS).select("project_id", "full_name", "referral_type", "issue")


def referral_type_distribution(spark, sf):
    return quality.type_distribution(P.cleaned_referrals(spark, sf))


def coverage_stats(spark, sf):
    return quality.coverage_stats(P.cleaned_referrals(spark, sf))


def null_profile(spark, sf):
    return quality.null_profile(P.cleaned_referrals(spark, sf).drop("_seq"))


def freshness_breakdown(spark, sf):
    return quality.freshness_breakdown(P.enriched_providers(spark, sf), AS_OF)


def call_log_rollup(spark, sf):
    return quality.call_log_rollup(td.call_log(spark, sf), slow_threshold_s=10.0).select(
        "function", "calls", _r("avg_s"), _r("max_s"), _r("error_pct"), "last_call", "slow")


def preferred_share(spark, sf):
    return quality.preferred_share(P.enriched_providers(spark, sf))


def freshness_table(spark, sf):
    return quality.freshness_table(P.enriched_providers(spark, sf), AS_OF)


def geocode_retry_join(spark, sf):
    """Successes of the first pass, plus retry hits joined back to contacts."""
    contacts = td.contact_table(spark, sf)
    cache = td.cache_table(spark, sf)
    todo = geocode.needs_geocoding(contacts, "address", "latitude", "longitude")
    resolved = geocode.resolve_addresses(todo, cache)
    retries = resolved.filter((F.col("status") == "hit") & (F.col("tier") > 0))
    joined = geocode.retry_join(todo, retries, "address", "full_name", "person_id")
    return joined.select("full_name", "person_id", _r("latitude"), _r("longitude"))


def referral_statistics(spark, sf):
    return quality.referral_statistics(P.cleaned_referrals(spark, sf))


def output_schema_check(spark, sf):
    refs = P.cleaned_referrals(spark, sf)
    return quality.output_schema_check(refs, {"full_name": "string", "work_address": "string", "work_phone": "string",
                                              "latitude": "double", "longitude": "double", "project_id": "bigint",
                                              "specialty": "string"})


def bidirectional_providers(spark, sf):
    return quality.bidirectional_providers(P.cleaned_referrals(spark, sf))


def address_audit(spark, sf):
    return quality.audit(td.contact_table(spark, sf), "person_id", address="address", lat="latitude", lon="longitude",
                         phone="phone", parts=("street", "city", "state", "zip"))


def address_advice(spark, sf):
    ok, errors, sugg = quality.address_parts_advice(F.col("street"), F.col("city"), F.col("state"), F.col("zip"))
    return td.contact_table(spark, sf).select("person_id", ok.alias("ok"), F.array_join(errors, "; ").alias("errors"),
                                         F.array_join(sugg, "; ").alias("suggestions"))


def duplicate_addresses(spark, sf):
    return quality.duplicate_address_savings(td.contact_table(spark, sf), "address")


# --- geocoding ----------------------------------------------------------------
def needs_geocoding(spark, sf):
    return geocode.needs_geocoding(td.contact_table(spark, sf), "address", "latitude", "longitude")


def geocode_resolved(spark, sf):
    todo = geocode.needs_geocoding(td.contact_table(spark, sf), "address", "latitude", "longitude")
    r = geocode.resolve_addresses(todo, td.cache_table(spark, sf))
    return r.select("address", _r("latitude"), _r("longitude"), "tier", "status")


def _geocoded(spark, sf):
    return geocode.enrich_contacts(td.contact_table(spark, sf), td.cache_table(spark, sf), "address", "latitude", "longitude")


def geocode_enriched(spark, sf):
    return _geocoded(spark, sf).select("person_id", "full_name", "address", _r("latitude"), _r("longitude"), "tier", "status")


def geocode_report(spark, sf):
    return geocode.geocode_report(_geocoded(spark, sf), "latitude", "longitude")


def _geocode_run(spark, sf) -> geocode.GeocodeRun:
    return geocode.GeocodeRun(td.contact_table(spark, sf), td.cache_table(spark, sf))


def geocode_merged(spark, sf):
    """I8's saved result: first-pass successes and retries, without repeats."""
    saved = _geocode_run(spark, sf).write(_new_folder(spark, "geocode"))
    return spark.read.parquet(saved["geocoded"]).select("full_name", "person_id", _r("latitude"), _r("longitude"))


def geocode_failures(spark, sf):
    return _geocode_run(spark, sf).failures


def geocode_work_list(spark, sf):
    return _geocode_run(spark, sf).work_list


def geocode_cache_merged(spark, sf):
    """The stored cache after the external geocoder's answers were merged into it."""
    path = f"{_new_folder(spark, 'cache')}/cache"
    geocode.update_cache(path, td.cache_table(spark, sf))
    geocode.update_cache(path, geocode.cache_entries(td.geocode_answers(_geocode_run(spark, sf).resolved)))
    return geocode.read_cache(spark, path).select("addr_key", _r("latitude"), _r("longitude"), "address", "found", "looked_up_at")


# --- reload of changed files ------------------------------------------------------
RELOAD_PARTS, RELOAD_PART = 8, 3


def reload_changed_files(spark, sf):
    """A3/A4: the export landed as several files, loaded, one of them replaced, loaded again: rows by part and by the
    refresh that read them."""
    base = _new_folder(spark, "reload")
    raw = td.raw_export(spark, sf).withColumn("part", F.pmod(F.col("_seq.l_orderkey"), F.lit(RELOAD_PARTS)))
    # Every task writes files of its own into each part: no part is one task's work.
    raw.write.options(**td.COMPACT).partitionBy("part").parquet(f"{base}/landing")
    snapshots.refresh(spark, f"{base}/landing", f"{base}/store")
    replaced = raw.filter((F.col("part") == RELOAD_PART) & (F.col("_seq.l_linenumber") > 1)).drop("part")
    replaced.write.mode("overwrite").options(**td.COMPACT).parquet(f"{base}/landing/part={RELOAD_PART}")
    snapshots.refresh(spark, f"{base}/landing", f"{base}/store")
    rows = snapshots.current(spark, f"{base}/store")
    part = F.pmod(F.col("_seq.l_orderkey"), F.lit(RELOAD_PARTS)).cast("int").alias("part")
    return rows.groupBy(part, F.col("_version").alias("loaded_in")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("`Project ID`").alias("projects"))


# --- streaming intake -----------------------------------------------------------
def _stream_run(spark, sf, runner, **parameters) -> str:
    """Land the derived export as arriving files, drain them with ``runner``; the target folder."""
    base = _new_folder(spark, "stream")
    raw = td.raw_export(spark, sf)
    # Two arrivals, drained one after the other, neither in input order.
    late = F.pmod(F.xxhash64("_seq"), F.lit(3)) == 0
    for rows in (raw.filter(late), raw.filter(~late)):
        rows.write.mode("append").options(**td.COMPACT).parquet(f"{base}/landing")
        runner(spark, f"{base}/landing", raw.schema, f"{base}/target", f"{base}/checkpoint", **parameters)
    return f"{base}/target"


def stream_intake(spark, sf):
    return spark.read.parquet(_stream_run(spark, sf, intake.run_intake)).drop("_seq")


def stream_first_seen(spark, sf):
    return intake.read_first_seen(spark, _stream_run(spark, sf, intake.run_first_seen))


def stream_first_seen_bounded(spark, sf):
    """The bounded variant with a watermark longer than the data: every ID once; which of its rows depends on arrival."""
    out = spark.read.parquet(_stream_run(spark, sf, intake.run_first_seen_bounded, watermark="20000 days"))
    return out.groupBy("referral_type", F.col("person_id").isNotNull().alias("has_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("person_id").alias("ids"))


def stream_running_counts(spark, sf):
    return intake.read_running_counts(spark, _stream_run(spark, sf, intake.run_running_counts))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        referrals_etl, preparation_summary, preparation_run, overlay_all_referrals, dataset_dispatch, sketch_report, clustered_window, provider_rollup, enriched_providers, inbound_counts,
        time_filtered_providers, time_based_counts, raw_inbound_counts, unique_specialties,
        preferred_list, preferred_missing_geo, preferred_summary,
        recommend_top10, recommend_ranked, recommend_preferred, recommend_specialty, best_provider,
        batch_top5, radius_pairs, scenario_comparison,
        data_quality, integrity_report, source_validation, providers_missing_geo, audit_summary, contact_phones, provider_validation, us_bounds_audit, issue_records,
        referral_type_distribution, coverage_stats, null_profile, freshness_breakdown, call_log_rollup,
        referral_statistics, output_schema_check, preferred_share, freshness_table, geocode_retry_join, bidirectional_providers, address_audit, address_advice, duplicate_addresses,
        needs_geocoding, geocode_resolved, geocode_enriched, geocode_report,
        geocode_merged, geocode_failures, geocode_work_list, geocode_cache_merged, reload_changed_files,
        stream_intake, stream_first_seen, stream_first_seen_bounded, stream_running_counts,
    ]
}
