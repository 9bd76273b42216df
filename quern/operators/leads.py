"""Lead intake: payloads of several sources to one record, merge, events, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import clean, first_non_empty, format_range, name_tokens, phone_key
from quern.operators.keyed import adopt_orphans, duplicate_flags, first_values, insert_ignore

FIELDS = ["name", "email", "project", "budget", "configuration", "location", "notes", "ad_id", "campaign_id", "form_id"]
# Names that sources give to a field.
ALIASES = {
    "name": ["name", "full_name", "fullName"],
    "email": ["email", "email_address"],
    "phone": ["phone", "mobile", "phone_number", "phoneNumber"],
    "project": ["project", "project_name", "projectName"],
    "budget": ["budget"],
    "configuration": ["configuration", "config", "bhk"],
    "location": ["location", "locality"],
    "notes": ["notes", "message", "remarks", "comments"],
    "possession_date": ["targetPossessionDate", "target_possession_date", "possession"],
    "user_type": ["user_type", "userType"],
    "source_lead_id": ["id", "enquiry_id"],
}
FORM_FIELDS = {
    "name": ["full_name", "name"],
    "email": ["email"],
    "phone": ["phone_number", "phone"],
    "project": ["project", "project_name", "which_project_are_you_interested_in?"],
    "budget": ["budget", "what_is_your_budget?"],
    "configuration": ["what_configuration_are_you_looking_for?", "configuration", "bhk"],
    "location": ["location", "city"],
}
PORTAL_FIELDS = {
    "name": ["lead_name", "name", "customer_name", "customerName"],
    "email": ["lead_email", "email", "customer_email"],
    "phone": ["lead_phone", "phone", "mobile", "customer_phone", "customerPhone"],
    "project": ["project_name", "project", "listing_title"],
    "configuration": ["apartment_names", "configuration", "bhk", "unit_type"],
    "source_lead_id": ["lead_id", "enquiry_id", "id"],
}


def pick(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that is there and not empty."""
    have = [n for n in names if n in df.columns]
    return first_non_empty(*(F.col(f"`{n}`") for n in have)) if have else F.lit(None).cast("string")


def website_leads(df: DataFrame, source: str = "website") -> DataFrame:
    out = {k: pick(df, v) for k, v in ALIASES.items()}
    return df.select(*(v.alias(k) for k, v in (out | {"phone": phone_key(out["phone"])}).items()), F.lit(source).alias("source"))


def form_leads(df: DataFrame, source: str = "meta") -> DataFrame:
    """Leads of ad forms: ``field_data`` is an array of (name, values); a form's name is its project if no answer is."""
    answers = F.map_from_entries(F.transform(F.array_distinct(F.transform("field_data", lambda f: F.lower(f["name"]))), lambda k: F.struct(k, F.element_at(F.filter("field_data", lambda f: F.lower(f["name"]) == k), -1)["values"])))
    asked = df.withColumn("_a", answers)

    def answer(names: list[str]) -> Column:
        return first_non_empty(*(F.get(F.col("_a")[n], F.lit(0)) for n in names))

    out = {k: answer(v) for k, v in FORM_FIELDS.items()}
    bhk = F.regexp_extract(out["configuration"], r"(?i)(\d)\s*bhk", 1)
    out["configuration"] = F.when(bhk != "", F.concat(bhk, F.lit(" BHK"))).otherwise(out["configuration"])
    out["phone"] = phone_key(out["phone"])
    out["project"] = F.coalesce(out["project"], pick(df, ["form_name"]))
    extra = {"source_lead_id": pick(df, ["leadgen_id", "leadgenId", "id"]), "ad_id": pick(df, ["ad_id"]), "form_id": pick(df, ["form_id"]), "campaign_id": pick(df, ["campaign_id"])}
    return asked.select(*(v.alias(k) for k, v in (out | extra).items()), F.lit(source).alias("source"))


def portal_leads(df: DataFrame, catalog: DataFrame | None = None, source: str = "housing") -> DataFrame:
    """Leads of a portal: prices to a budget text, places joined, ids made of project and date."""
    out = {k: pick(df, v) for k, v in PORTAL_FIELDS.items()}
    name = F.nullif(clean(F.regexp_replace(out["name"], r"(?i)\bundefined\b", "")), F.lit(""))
    low, high = (F.col(c) if c in df.columns else F.lit(None).cast("long") for c in ("min_price", "max_price"))
    places = [F.nullif(F.col(c), F.lit("")) for c in ("locality_name", "city_name") if c in df.columns]
    place = F.coalesce(F.nullif(F.concat_ws(", ", *places), F.lit("")) if places else F.lit(None).cast("string"), pick(df, ["location", "locality"]))
    made = F.when(F.col("project_id").isNotNull() & F.col("lead_date").isNotNull(), F.concat_ws("-", F.col("project_id").cast("string"), F.col("lead_date").cast("string"))) if {"project_id", "lead_date"} <= set(df.columns) else F.lit(None).cast("string")
    out |= {
        "name": F.when(name != "(Owner)", name),
        "phone": phone_key(out["phone"], F.col("country_code") if "country_code" in df.columns else None),
        "budget": F.coalesce(format_range(low, high), pick(df, ["budget"])),
        "location": place,
        "source_lead_id": F.coalesce(made, out["source_lead_id"]),
        "_text": pick(df, ["enquiry", "message", "subject", "remarks"]),
    }
    rows = df.select(*(v.alias(k) for k, v in out.items()), F.lit(source).alias("source"))
    if catalog is None:
        return rows.drop("_text")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    matched = match_projects(rows.where("project IS NULL").select("_row", "_text"), "_row", "_text", catalog, "name").select("_row", F.col("name").alias("_match"))
    return rows.join(matched, "_row", "left").withColumn("project", F.coalesce("project", "_match")).drop("_row", "_match", "_text")


def normalized(payloads: dict[str, DataFrame], catalog: DataFrame | None = None) -> DataFrame:
    """All sources in one record; unknown sources are read like a website's flat fields."""
    out = None
    for source, df in payloads.items():
        rows = form_leads(df, source) if source == "meta" else portal_leads(df, catalog, source) if source == "housing" else website_leads(df, source)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def match_projects(texts: DataFrame, key: str, text: str, catalog: DataFrame, name: str, least: float = 0.5) -> DataFrame:
    """(key, name): the catalog name of which most words (over two letters) are in the text, half at least.

    Words match as substrings, so this is a nested loop of texts over the words of
    the catalog, which is a dimension table: keep it small (thousands of names).
    Of equal scores the first name in alphabetical order is taken.
    """
    names = catalog.select(F.col(name).alias("name"), F.filter(F.split(F.lower(F.col(name)), r"\s+"), lambda t: F.length(t) > 2).alias("_tokens")).where(F.size("_tokens") > 0).distinct()
    words = names.select("name", "_tokens", F.explode("_tokens").alias("_t"))
    hay = texts.select(key, F.lower(F.col(text)).alias("_hay")).where("_hay IS NOT NULL")
    found = hay.join(words, F.contains("_hay", "_t")).groupBy(key, "name").agg((F.count("*") / F.first(F.size("_tokens"))).alias("_score")).where(F.col("_score") >= least)
    return found.groupBy(key).agg(F.min_by("name", F.struct(-F.col("_score"), F.col("name"))).alias("name"), F.max("_score").alias("score"))


def name_overlap(asked: Column, found: Column) -> Column:
    """Whether two names share a word, and at least 0.34 of the asked ones; an empty side passes."""
    both, n = F.size(F.array_intersect(asked, found)), F.size(asked)
    return F.when((n <= 0) | (F.size(found) <= 0), F.lit(True)).otherwise((both >= 1) & (both / n >= 0.34))


def tokens_overlap(a: str, b: str) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def intake(touches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, touches) of normalized rows with ``seq`` (arrival order): one lead per phone, first values win.

    A source's lead id counts once per lead; the first touch of a lead is no duplicate.
    """
    valid = touches.where(F.col("phone").isNotNull())
    for f in FIELDS:
        if f not in valid.columns:
            valid = valid.withColumn(f, F.lit(None).cast("string"))
    leads = first_values(valid, ["phone"], FIELDS, ["seq"], F.min("seq").alias("id"), F.min_by("source", "seq").alias("primary_source"), F.count("*").alias("n_touches"))
    leads = leads.withColumns({"status": F.lit("New"), "qualification": F.lit("unknown"), "crm_status": F.lit("not_pushed")})
    key = F.when(F.coalesce(F.col("source_lead_id"), F.lit("")) != "", F.concat_ws("\x01", "phone", "source", "source_lead_id"))
    kept = insert_ignore(valid.withColumn("_key", key), "_key", ["seq"]).drop("_key")
    return leads, duplicate_flags(kept, ["phone"], ["seq"])


# Steps of the two channels: key, label, carries a payload.
LADDERS = {
    "whatsapp": [
        ("template_sent", "Template sent", False), ("delivered", "Delivered to phone", False), ("failed", "Delivery failed", True),
        ("resent", "Resent", False), ("lead_replied", "Lead replied", False), ("no_reply", "No reply", False), ("followup_sent", "Follow-up sent", False),
        ("requirements_shared", "Requirements shared", True), ("options_shared", "Options shared", True), ("detail_shared", "Property details shared", True),
        ("advisor_requested", "Talk to an advisor", False), ("opted_out", "Opted out", False), ("tagging_sent", "Tagging sent", True),
    ],
    "voice": [
        ("call_attempted", "Call attempted", False), ("call_no_answer", "No answer", False), ("call_busy", "Line busy", False),
        ("call_failed", "Call failed", True), ("call_connected", "Call connected", True), ("call_disposition", "Outcome recorded", True),
    ],
}
VOICE_STATES = {"answered": "call_connected", "completed": "call_connected", "no-answer": "call_no_answer", "no_answer": "call_no_answer", "busy": "call_busy", "failed": "call_failed", "error": "call_failed"}


def validated_events(raw: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected rows with ``reason``); a bad event time becomes ``now``, a missing key is made of the event."""
    steps = F.create_map(*(x for c, s in LADDERS.items() for x in (F.lit(c), F.array(*(F.lit(k) for k, _, _ in s)))))
    at = F.coalesce(F.try_to_timestamp("occurred_at"), now)
    phone = phone_key("phone")
    reason = (
        F.when(phone.isNull(), "invalid_phone")
        .when(~F.coalesce(F.col("channel"), F.lit("")).isin(list(LADDERS)), "invalid_channel")
        .when(~F.coalesce(F.array_contains(F.element_at(steps, F.col("channel")), F.col("checkpoint")), F.lit(False)), "invalid_checkpoint")
    )
    checked = raw.withColumn("reason", reason)
    key = F.coalesce(F.nullif(F.col("idempotency_key"), F.lit("")), F.concat_ws(":", phone, "channel", "checkpoint", F.unix_millis(at).cast("string")))
    valid = checked.where("reason IS NULL").drop("reason").withColumns({"phone": phone, "occurred_at": at, "idempotency_key": key, "received_at": now})
    return valid, checked.where("reason IS NOT NULL")


def with_attempts(calls: DataFrame) -> DataFrame:
    """Voice results (phone, attempt_id, status, duration seconds, at): the result and the attempt that came before it."""
    state = F.element_at(F.create_map(*(F.lit(x) for p in VOICE_STATES.items() for x in p)), F.lower("status"))
    key = F.concat(F.lit("call:"), F.col("attempt_id"))
    result = F.struct(state.alias("checkpoint"), F.col("at").alias("occurred_at"), key.alias("idempotency_key"))
    start = F.timestamp_millis(F.unix_millis("at") - F.round(F.coalesce("duration", F.lit(0)) * 1000).cast("long"))
    attempt = F.struct(F.lit("call_attempted").alias("checkpoint"), start.alias("occurred_at"), F.concat(key, F.lit(":attempted")).alias("idempotency_key"))
    rows = calls.where(state.isNotNull()).select("phone", F.lit("voice").alias("channel"), F.explode(F.array(result, attempt)).alias("e"))
    return rows.select("phone", "channel", "e.*")


def ingest(stored_events: DataFrame, new: DataFrame, leads: DataFrame) -> DataFrame:
    """Events after a batch: new keys only, orphans adopted by leads of their phone."""
    fresh = insert_ignore(new, "idempotency_key", ["occurred_at", "phone"])
    known = stored_events.where("idempotency_key IS NOT NULL").select("idempotency_key")
    added = fresh.join(known, "idempotency_key", "left_anti").select(*new.columns)
    return adopt_orphans(stored_events.unionByName(added, allowMissingColumns=True), leads)


def test_lead(field_data: str, marker: str = "<test lead") -> Column:
    """Whether any answer starts with a test marker."""
    return F.exists(F.flatten(F.transform(field_data, lambda f: f["values"])), lambda v: F.startswith(F.lower(v), F.lit(marker)))


def webhook_changes(payloads: DataFrame, field: str = "leadgen") -> DataFrame:
    """``entry[].changes[]`` as rows, of one field."""
    rows = payloads.select(F.explode("entry").alias("e")).select(F.col("e.id").alias("entry_id"), F.explode("e.changes").alias("c"))
    return rows.where(F.col("c.field") == field).select("entry_id", "c.value")


def push_rows(leads: DataFrame, labels: dict[str, str]) -> DataFrame:
    """CRM rows: empty values out, buyer by default, sources by their label; a JSON text of what is left."""
    source = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), F.col("primary_source")), F.initcap("primary_source")) if labels else F.initcap("primary_source")
    fields = [F.nullif(F.col(f), F.lit("")).alias(f) for f in ("name", "phone", "email", "project", "budget", "configuration", "location", "notes")]
    return leads.select("id", F.to_json(F.struct(*fields, F.lit("buyer").alias("user_type"), source.alias("source"))).alias("row"))


def conversion_rows(leads: DataFrame, as_of: Column) -> DataFrame:
    """Conversion events with hashed identifiers; qualification decides the name."""
    name = F.when(F.col("qualification") == "qualified", "QualifiedLead").when(F.col("qualification") == "disqualified", "DisqualifiedLead").otherwise("Lead")
    hashed = {c: F.sha2(F.lower(F.trim(F.col(c))), 256) for c in ("email", "phone")}
    return leads.select("id", name.alias("event_name"), F.unix_timestamp(as_of).alias("event_time"), *(h.alias(f"{c}_sha256") for c, h in hashed.items()), F.concat_ws("-", F.col("id").cast("string"), name).alias("event_id"))
