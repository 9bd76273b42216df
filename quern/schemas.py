"""Record types as DDL strings. Money is in rupees unless a name says lakhs (``_l``) or crores (``_cr``)."""

LEAD = (
    "id long, phone string, name string, email string, project string, budget string, configuration string, location string, notes string, "
    "ad_id string, campaign_id string, form_id string, status string, sub_status string, qualification string, qualification_source string, "
    "qualification_locked int, qualified_at timestamp, crm_status string, primary_source string, possession_date string, amenities string, created_at timestamp, updated_at timestamp"
)
TOUCH = "id long, lead_id long, source string, source_lead_id string, is_duplicate int, raw_payload string, received_at timestamp"
EVENT = "id long, lead_id long, phone string, channel string, checkpoint string, payload string, source_ref string, idempotency_key string, occurred_at timestamp, received_at timestamp"
SYNC_RUN = "id long, source string, status string, fetched long, created long, duplicates long, error string, ran_at timestamp"
PUSH = "id long, lead_id long, status string, error string, pushed_at timestamp"
EDIT = "id long, lead_id long, field string, old_value string, new_value string, edited_by string, edited_at timestamp"
PROJECT = (
    "id string, name string, location string, city string, nearby_locality string, config string, possession string, possession_date string, "
    "budget_min_l double, budget_max_l double, amenities array<string>, rera string, media array<struct<url:string,tag:string>>, description string, "
    "brochure_url string, developer string, from_cache boolean, stale boolean"
)
EVIDENCE = (
    "seq long, title string, description string, source string, source_url string, source_type string, price struct<min_inr:long,max_inr:long,display:string>, "
    "carpet_area struct<value_sqft:double,display:string>, location string, city string, configuration array<string>, amenities array<string>, developer string, rera string, "
    "possession string, latitude double, longitude double, captured_at string"
)
EXTERNAL = (
    "id string, name string, city string, location string, community string, configuration string, bedrooms int, budget_min long, budget_max long, "
    "handover_date string, possession_date string, source_quality string, source_name string, last_seen_at string, rera string, developer string, url string"
)
PLACE = "id string, name string, types array<string>, latitude double, longitude double, website string"
FACT = "property_id string, field string, value string, source string, source_url string, captured_at string, confidence double, configuration string, seq long"
GAZETTEER_LOCALITY = "name string, city string, market string"
GAZETTEER_ALIAS = "alias string, seq int, canonical string, parent string, city string, market string"
