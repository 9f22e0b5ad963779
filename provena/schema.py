"""Canonical column names, fixed values and bounds.

The values in the FIXED VALUES blocks must equal what the referral exports
and the application expect (export header names, literal source labels,
state names); they are data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: tokens that mean "missing" in text cells of the exports.
# ---------------------------------------------------------------------------
MISSING_TOKENS = ["", "nan", "None", "NaN"]

# ---------------------------------------------------------------------------
# FIXED VALUES: literal labels used by the referral exports.
# ---------------------------------------------------------------------------
DOCTOR_OFFICE_SOURCE = "Referral - Doctor's Office"
OUTBOUND_SOURCE = "Outbound Referral"
EXCEL_EPOCH = "1899-12-30 00:00:00"
MIN_PLAUSIBLE_DATE = "1990-01-01 00:00:00"
EARTH_RADIUS_MILES = 3958.8

# ---------------------------------------------------------------------------
# FIXED VALUES: raw export header names, grouped by the party they describe.
# Each group maps the export header to our canonical snake_case column.
# ---------------------------------------------------------------------------
RAW_PROJECT_ID = "Project ID"
RAW_INTAKE = "Date of Intake"
RAW_CREATE = "Create Date"

RAW_SIGN_UP = "Sign Up Date"
RAW_VERIFIED = "Last Verified Date"
RAW_REFERRAL_DATE = "Referral Date"
# Date headers, in the order in which one becomes the referral date.
RAW_DATE_HEADERS = [RAW_CREATE, RAW_INTAKE, RAW_SIGN_UP]
# Canonical headers and what follows a party's name in the export.
OVERLAY_HEADERS = {
    "Full Name": " Full Name",
    "Work Phone": "'s Work Phone",
    "Work Address": "'s Work Address",
    "Latitude": "'s Details: Latitude",
    "Longitude": "'s Details: Longitude",
    "Last Verified Date": "'s Details: Last Verified Date",
}

PRIMARY_FROM = {
    "Referral Source": "referral_source",
    "Referred From Full Name": "full_name",
    "Referred From's Work Phone": "work_phone",
    "Referred From's Work Address": "work_address",
    "Referred From's Details: Latitude": "latitude",
    "Referred From's Details: Longitude": "longitude",
    "Referred From's Details: Last Verified Date": "last_verified_date",
    "Referred From's Details: Person ID": "person_id",
}
SECONDARY_FROM = {
    "Secondary Referral Source": "referral_source",
    "Secondary Referred From Full Name": "full_name",
    "Secondary Referred From's Work Phone": "work_phone",
    "Secondary Referred From's Work Address": "work_address",
    "Secondary Referred From's Details: Latitude": "latitude",
    "Secondary Referred From's Details: Longitude": "longitude",
    "Secondary Referred From's Details: Last Verified Date": "last_verified_date",
    "Secondary Referred From's Details: Person ID": "person_id",
}
REFERRED_TO = {
    "Dr/Facility Referred To Full Name": "full_name",
    "Dr/Facility Referred To's Work Phone": "work_phone",
    "Dr/Facility Referred To's Work Address": "work_address",
    "Dr/Facility Referred To's Details: Latitude": "latitude",
    "Dr/Facility Referred To's Details: Longitude": "longitude",
    "Dr/Facility Referred To's Details: Last Verified Date": "last_verified_date",
    "Dr/Facility Referred To's Details: Person ID": "person_id",
}
PREFERRED_CONTACT = {
    "Contact Full Name": "full_name",
    "Contact's Work Phone": "work_phone",
    "Contact's Work Address": "work_address",
    "Contact's Details: Latitude": "latitude",
    "Contact's Details: Longitude": "longitude",
    "Contact's Details: Specialty": "specialty",
    "Contact's Details: Last Verified Date": "last_verified_date",
    "Contact's Details: Person ID": "person_id",
}
# Person-ID headers are optional: their absence is not reported.
OPTIONAL_HEADERS = {
    "Referred From's Details: Person ID",
    "Secondary Referred From's Details: Person ID",
    "Dr/Facility Referred To's Details: Person ID",
    "Contact's Details: Person ID",
}
RAW_VERIFIED_HEADERS = [
    "Referred From's Details: Last Verified Date",
    "Secondary Referred From's Details: Last Verified Date",
    "Dr/Facility Referred To's Details: Last Verified Date",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: US state names and their postal codes (50 states + DC).
# ---------------------------------------------------------------------------
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR",
    "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
}

# FIXED VALUES: street lines that look like placeholders.
TEST_STREETS = ["test", "example", "123 test st", "123 main st"]

# Coordinate bounds (three different bounds are used on purpose, see README).
GEOCODE_ABS_MAX = 180.0          # cleaning accepts |lat|,|lon| <= 180
REPORT_LAT_MAX, REPORT_LON_MAX = 90.0, 180.0
US_LAT_RANGE, US_LON_RANGE = (20.0, 70.0), (-180.0, -60.0)

# ---------------------------------------------------------------------------
# Canonical long referral table.
# ---------------------------------------------------------------------------
REFERRALS_SCHEMA = T.StructType([
    T.StructField("project_id", T.LongType()),
    T.StructField("date_of_intake", T.TimestampNTZType()),
    T.StructField("referral_source", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("work_phone", T.StringType()),
    T.StructField("work_address", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("last_verified_date", T.TimestampNTZType()),
    T.StructField("person_id", T.StringType()),
    T.StructField("referral_type", T.StringType()),
])
REFERRAL_COLUMNS = [f.name for f in REFERRALS_SCHEMA.fields]

# ---------------------------------------------------------------------------
# FIXED VALUES: audit messages (address parts, advisory address check,
# one-line address, coordinates, phone), in the order the checks run.
# ---------------------------------------------------------------------------
AUDIT_MESSAGES = {
    "street_required": "Street address is required",
    "city_required": "City is required",
    "state_required": "State is required",
    "zip_required": "ZIP code is required",
    "zip_format": "ZIP code must be in format 12345 or 12345-6789",
    "address_valid": "Valid address",
    "city_recommended": "City is recommended for better geocoding accuracy",
    "state_recommended": "State is recommended for better geocoding accuracy",
    "state_unknown_suffix": "' may not be a valid US state abbreviation",
    "state_two_letters": "Consider using 2-letter state abbreviation (e.g., 'MD' instead of 'Maryland')",
    "zip_advice": "ZIP code should be 5 digits (e.g., '20746') or ZIP+4 format (e.g., '20746-1234')",
    "test_street": "Address appears to be a test value - please enter a real address",
    "address_empty": "Address cannot be empty",
    "address_short": "Address appears too short. Please provide a complete address.",
    "address_number": "Address should include a street number",
    "address_hint": "Consider adding state and ZIP code for better accuracy",
    "coords_numeric": "Coordinates must be numeric",
    "lat_range": "Latitude must be between -90 and 90",
    "lon_range": "Longitude must be between -180 and 180",
    "coords_valid": "Valid coordinates",
    "phone_optional": "Phone number is optional",
    "phone_valid": "Valid phone number",
    "phone_invalid": "Phone number must be 10 digits or 11 digits starting with 1",
}
