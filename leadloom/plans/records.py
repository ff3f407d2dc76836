"""Queries over raw items, records and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places
from ..functions import records as rc
from ..functions import text as tx
from ..operators import extraction as ex
from ..session import ship
from .registry import query

RAW_DATE = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS VARCHAR) ELSE 'at ' || event_type END"


def _raw_date():
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    return F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.unix_timestamp(at).cast("string")).when(kind == 2, (F.unix_timestamp(at) * 1000).cast("string")).otherwise(F.concat(F.lit("at "), "event_type"))


@query(f"WITH r AS (SELECT event_id, {RAW_DATE} raw FROM events), p AS (SELECT event_id, coalesce(CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CASE WHEN CAST(raw AS BIGINT) > 1000000000000 THEN CAST(raw AS BIGINT) // 1000 ELSE CAST(raw AS BIGINT) END END, CAST(epoch(TRY_CAST(replace(raw, 'Z', '') AS TIMESTAMP)) AS BIGINT)) posted FROM r) SELECT event_id, posted, posted < 1706054400 AS sane FROM p")
def date_parse(t):
    """FN-4, FN-5: ISO, seconds and milliseconds; whether the time lies within bounds (until 24 January here)."""
    raw = _raw_date()
    posted = F.unix_timestamp(rc.when_posted(raw))
    return t.events.select("event_id", posted.alias("posted"), F.when(posted.isNotNull(), rc.sane_date(raw, F.timestamp_seconds(F.lit(1706054399))).isNotNull()).alias("sane"))


@query("SELECT kind, total, total * CASE WHEN kind LIKE 'minute%' THEN 60 WHEN kind LIKE 'hour%' THEN 3600 WHEN kind LIKE 'day%' THEN 86400 END AS seconds FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'day' ELSE 'moons' END kind, p_size total FROM part GROUP BY ALL)")
def window_text(t):
    kind = F.when(F.col("p_size") % 4 == 0, "minutes").when(F.col("p_size") % 4 == 1, "hours").when(F.col("p_size") % 4 == 2, "day").otherwise("moons")
    rows = t.part.select(kind.alias("kind"), F.col("p_size").alias("total")).distinct()
    return rows.withColumn("seconds", rc.window_seconds(F.concat_ws(" ", F.col("total").cast("string"), "kind")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE sha1(lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|' || lower(trim(p_type)))[1:32] END content_key, sha256(p_name)[1:24] key_hash, sha256(p_name)[1:12] session_hash FROM part")
def content_keys(t):
    """FN-2, FN-3, FN-3b."""
    blank = F.col("p_partkey") % 7 == 0
    parts = (F.when(~blank, F.col(c)).otherwise(F.lit(" ")) for c in ("p_name", "p_brand", "p_type"))
    return t.part.select("p_partkey", rc.content_key(*parts).alias("content_key"), rc.short_hash(F.col("p_name"), 24).alias("key_hash"), rc.short_hash(F.col("p_name"), 12).alias("session_hash"))


@query("""WITH n AS (SELECT c_custkey, c_mktsegment kind, c_custkey + 1 AS k FROM customer) SELECT c_custkey, CASE kind WHEN 'AUTOMOBILE' THEN k WHEN 'BUILDING' THEN k * 1000 + 500 WHEN 'FURNITURE' THEN k * 1000 + k % 1000 WHEN 'HOUSEHOLD' THEN k ELSE k * 1000000 END AS members FROM n""")
def humanised_numbers(t):
    """FN-14: the number of members among other numbers."""
    kind, k = F.col("c_mktsegment"), F.col("c_custkey") + 1
    text = k.cast("string")
    grouped = F.concat(text, F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    said = (
        F.when(kind == "AUTOMOBILE", F.concat(text, F.lit(" members, 7 km away, since 1999")))
        .when(kind == "BUILDING", F.concat(F.lit("Public · 3 posts a day · "), text, F.lit(",5 tys. członków")))
        .when(kind == "FURNITURE", F.concat(grouped, F.lit(" Mitglieder seit 2011")))
        .when(kind == "HOUSEHOLD", F.concat(F.lit("group "), text, F.lit(", more kept")))
        .otherwise(F.concat(text, F.lit(" mln")))
    )
    return t.customer.select("c_custkey", rc.humanised(said).alias("members"))


#: What services say, by priority; the status comes from the price, so that both meet in every way.
SAID = {"1-URGENT": "Monthly QUOTA used up", "2-HIGH": "request timed out", "3-MEDIUM": "Limit exceeded for today", "4-NOT SPECIFIED": "gateway TIMEOUT"}
STATUS_SQL = "[200, 401, 403, 429, 500, 503][1 + CAST(floor(o_totalprice / 100) AS BIGINT) % 6]"


@query("WITH m AS (SELECT o_orderpriority, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAID.items()) + f""" ELSE o_orderpriority END m, {STATUS_SQL} s FROM orders)
SELECT o_orderpriority, s AS status, CASE WHEN lower(m) LIKE '%quota%' OR lower(m) LIKE '%limit exceeded%' THEN 'exhausted' WHEN s IN (401, 403) THEN 'denied' WHEN s = 429 THEN 'throttled' WHEN s >= 500 THEN 'server' WHEN lower(m) LIKE '%timed out%' OR lower(m) LIKE '%timeout%' THEN 'timeout' ELSE 'other' END kind, count(*) n FROM m GROUP BY ALL""")
def error_classes(t):
    """FN-27: words before the status, the status before other words."""
    words = F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair))
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 429, 500, 503))), (F.floor(F.col("o_totalprice") / 100) % 6 + 1).cast("int"))
    message = F.coalesce(words[F.col("o_orderpriority")], F.col("o_orderpriority"))
    return t.orders.groupBy("o_orderpriority", status.alias("status"), rc.error_class(message, status).alias("kind")).agg(F.count("*").alias("n"))


CLASSES = {"price": "(?i)price|cost|cheap", "place": "(?i)city|street|river", "time": "(?i)today|tomorrow|night", "person": "(?i)friend|family|people"}


@query("SELECT kind, count(*) n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in CLASSES.items()) + " ELSE 'other' END kind FROM documents) GROUP BY kind")
def feedback_categories(t):
    return t.documents.groupBy(rc.first_class(F.col("text"), CLASSES, "other").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'lead' WHEN c_custkey % 10 BETWEEN 2 AND 4 AND NOT c_custkey % 100 BETWEEN 12 AND 14 THEN 'leady' ELSE 'leadow' END form, greatest(1, CAST(ceil(c_custkey / 60) AS BIGINT)) AS minutes FROM customer")
def plural_and_minutes(t):
    """FN-22, FN-26."""
    return t.customer.select("c_custkey", rc.plural(F.col("c_custkey"), "lead", "leady", "leadow").alias("form"), rc.started_minutes(F.col("c_custkey")).alias("minutes"))


@query(r"SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')!', '([_*\[\]()~`>#+=|{}.!-])', '\\\1', 'g') AS escaped, p_name[1:8] AS hard FROM part")
def markdown_text(t):
    """FN-23, FN-10."""
    return t.part.select("p_partkey", rc.markdown_escaped(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!"))).alias("escaped"), F.substring("p_name", 1, 8).alias("hard"))


@query(r"SELECT p_partkey, len(list_filter(regexp_split_to_array(replace(p_name, ' ', '; ') || ',,x', '[\s,;]+'), lambda x: x <> '')) AS parts FROM part")
def list_split(t):
    return t.part.select("p_partkey", F.size(rc.split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(",,x")))).cast("long").alias("parts"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(url, '://', '://u:p@'), '^([a-z]+://)[^/@]*@', '\\1'), '[?#].*$', '') AS identity, regexp_extract(url, '^[a-z]+://([^/?#]+(?:/[^/?#]+)?)', 1) || CASE WHEN length(url) > length(regexp_extract(url, '^([a-z]+://[^/?#]+(?:/[^/?#]+)?)', 1)) + 1 THEN '/…' ELSE '' END AS label FROM pages")
def url_identities(t):
    """FN-34, FN-18."""
    return t.pages.select("page_id", rc.url_identity(F.replace("url", F.lit("://"), F.lit("://u:p@"))).alias("identity"), rc.url_label(F.col("url")).alias("label"))


@query("SELECT doc_id, least(1024, length(text)) < length(text) AS cut, CASE WHEN length(text) <= 1024 - length(source) - 1 THEN length(text) + length(source) + 1 ELSE 1024 END AS size FROM documents")
def caption_fit(t):
    found = rc.caption(F.col("source"), F.col("text"))
    return t.documents.select("doc_id", (F.length("text") > 1024).alias("cut"), F.length(found).cast("long").alias("size"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'closed' WHEN c_custkey % 3 = 1 THEN 'open' ELSE 'unknown' END privacy, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'small' END, CASE WHEN c_acctbal < 0 THEN 'debt' END) notes, 'https://search.example/?q=' || replace(replace(c_name, '#', '%23'), ' ', '+') AS search FROM customer")
def candidate_hints(t):
    """FN-15, FN-16, FN-32."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "Private group").when(k % 3 == 1, "Public group").otherwise("Group")
    privacy = F.when(F.lower(said).contains("private"), "closed").when(F.lower(said).contains("public"), "open").otherwise("unknown")
    notes = rc.joined_notes(F.when(k % 2 == 0, F.lit("small")), F.when(F.col("c_acctbal") < 0, F.lit("debt")))
    return t.customer.select("c_custkey", privacy.alias("privacy"), notes.alias("notes"), F.concat(F.lit("https://search.example/?q="), F.url_encode("c_name")).alias("search"))


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{lang}')" for lang, words in tx.FUNCTION_WORDS.items() for w in words[:3]) + ") v(word, said)) SELECT conv_id, turn, min(said) AS lang FROM conversations LEFT JOIN p ON word = regexp_extract(lower(text), '^[^ ,.]+') GROUP BY 1, 2")
def phrase_language(t):
    """FN-17: the language of a turn's first word by a small table; the first of several."""
    phrases = t.spark.createDataFrame([(w, lang) for lang, words in tx.FUNCTION_WORDS.items() for w in words[:3]], "word string, said string")
    first = t.conversations.select("conv_id", "turn", F.regexp_extract(F.lower("text"), "^[^ ,.]+", 0).alias("word"))
    return first.join(F.broadcast(phrases), "word", "left").groupBy("conv_id", "turn").agg(F.min("said").alias("lang"))


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '?' WHEN p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48 AND p_type <> 'ECONOMY') THEN p_brand || ' (unknown)' WHEN p_size < 25 THEN p_brand || ' (?)' ELSE p_brand END place FROM part")
def place_labels(t):
    """PRJ-12b: brands as places: some are not known, small parts are unsure of theirs."""
    known = t.part.where("p_size > 48 and p_type <> 'ECONOMY'").select("p_brand", F.lit(True).alias("known")).distinct()
    rows = t.part.join(known, "p_brand", "left")
    return rows.select("p_partkey", rc.place_label(F.when(F.col("p_type") != "ECONOMY", F.col("p_brand")), F.col("p_size") >= 25, F.coalesce("known", F.lit(False))).alias("place"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN u::VARCHAR ELSE CASE WHEN round(100 * u / 400) >= 90 THEN '! ' ELSE '' END || u || ' / 400 (' || CAST(round(100 * u / 400) AS BIGINT) || ' %)' END line, CASE WHEN s_suppkey % 5 <> 0 THEN 400 - u END AS remaining FROM (SELECT s_suppkey, s_suppkey * 37 % 401 u FROM supplier)")
def account_usage(t):
    """PRJ-10, PRJ-11: use, limit and what remains, from answers of unlike shapes."""
    used = F.col("s_suppkey") * 37 % 401
    shapes = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.struct(used.alias("used")).alias("data")))).otherwise(F.to_json(F.struct(used.alias("usage"))))
    found = F.coalesce(F.get_json_object("answer", "$.data.used"), F.get_json_object("answer", "$.usage")).cast("long")
    limit = F.when(F.col("s_suppkey") % 5 != 0, F.lit(400).cast("long"))
    rows = t.supplier.select("s_suppkey", shapes.alias("answer")).select("s_suppkey", found.alias("used"), limit.alias("most"))
    return rows.select("s_suppkey", rc.usage_line(F.col("used"), F.col("most")).alias("line"), (F.col("most") - F.col("used")).alias("remaining"))


def _answer():
    """A model's answer of an order: sound, with a fence around it, with faults, or no object at all."""
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"is_order": '), F.when(k % 2 == 0, '"tak"').otherwise("false"), F.lit(', "direction": "'), F.when(k % 5 == 0, "OFFER").when(k % 5 == 1, "sideways").otherwise("demand"),
        F.lit('", "from_code": "'), F.when(k % 3 == 0, "00-950").when(k % 3 == 1, "12").otherwise("123 45"), F.lit('", "urgency": "'), F.when(k % 4 == 0, "now").otherwise("later"),
        F.lit('", "contact_kind": "phone", "contact": "'), F.when(k % 2 == 0, "+48 601 602 603").otherwise("call me"), F.lit('", "price": "'), (k % 900).cast("string"), F.lit(' zl", "confidence": "'), (k % 130).cast("string"), F.lit('"'),
        F.when(k % 7 == 0, ', "mood": 1').otherwise(""), F.lit("}"),
    )
    return F.when(k % 11 == 0, F.lit("no idea")).when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


#: Answers of a task: a file of one row group is one task else.
ANSWERS = 100_000


def _asked(t):
    """Keys of orders, dealt over tasks."""
    keys = t.orders.select("o_orderkey")
    return keys.repartition(max(1, -(-keys.count() // ANSWERS)), "o_orderkey")


SOUND = "o_orderkey % 11 <> 0"
CHECKED = f"""SELECT o_orderkey, {SOUND} AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS is_order,
CASE WHEN o_orderkey % 11 = 0 THEN 'unclear' WHEN o_orderkey % 5 = 0 THEN 'offer' WHEN o_orderkey % 5 = 1 THEN 'unclear' ELSE 'demand' END direction,
CASE WHEN {SOUND} THEN CASE o_orderkey % 3 WHEN 0 THEN '00950' WHEN 2 THEN '12345' END END code,
CASE WHEN {SOUND} AND o_orderkey % 4 = 0 THEN 'now' WHEN {SOUND} THEN 'later' ELSE 'none' END urgency,
CASE WHEN {SOUND} AND o_orderkey % 2 = 0 THEN 'phone' ELSE 'none' END contact_kind, CASE WHEN {SOUND} AND o_orderkey % 2 = 0 THEN '601602603' END contact,
CASE WHEN {SOUND} AND o_orderkey % 900 > 0 THEN CAST(o_orderkey % 900 AS DOUBLE) END price, CASE WHEN {SOUND} THEN CAST(least(100, o_orderkey % 130) AS INTEGER) ELSE 0 END confidence FROM orders"""


@query(CHECKED)
def record_validation(t):
    """EX-4 to EX-10."""
    rec = ex.record(_answer())
    rows = _asked(t).select("o_orderkey", rec.alias("r"))
    return rows.select("o_orderkey", "r.is_order", "r.direction", F.col("r.from_code").alias("code"), "r.urgency", F.col("r.contact.kind").alias("contact_kind"), F.col("r.contact.value").alias("contact"), "r.price", "r.confidence")


@query(f"WITH r AS ({CHECKED}) SELECT count(*) n, count(*) FILTER (is_order AND urgency = 'now' AND confidence >= 60 AND contact_kind <> 'none') wake FROM r")
def worth_waking(t):
    """EX-12."""
    rows = _asked(t).select(ex.record(_answer()).alias("r"))
    return rows.agg(F.count("*").alias("n"), F.count_if(ex.worth_waking(F.col("r"))).alias("wake"))


TEXT_CODES = "'from 11-222 over ' || CASE WHEN o_orderkey % 2 = 0 THEN '00-950' ELSE '54321' END || ' end'"


@query(f"WITH r AS ({CHECKED}), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN code END code, list_filter(['11222', CASE WHEN o_orderkey % 2 = 0 THEN '00950' ELSE '54321' END], lambda x: x IS DISTINCT FROM (CASE WHEN o_orderkey % 13 <> 0 THEN code END)) spare, o_orderkey % 13 = 0 AS blank FROM r) SELECT o_orderkey, CASE WHEN blank THEN NULL ELSE coalesce(code, spare[1]) END from_code, CASE WHEN blank THEN NULL ELSE CASE WHEN code IS NULL THEN spare[2] ELSE spare[1] END END to_code FROM c")
def answer_path(t):
    """EX-11, EX-21, EX-21b: empty texts give the defaults; empty codes are filled from the text."""
    k = F.col("o_orderkey")
    text = F.when(k % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("from 11-222 over "), F.when(k % 2 == 0, "00-950").otherwise("54321"), F.lit(" end")))
    rows = ex.answered(_asked(t).select("o_orderkey", text.alias("text"), _answer().alias("answer")), "text", "answer")
    return rows.select("o_orderkey", "record.from_code", "record.to_code")


@query(f"WITH d AS (SELECT o_orderkey, CAST(2 + CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 7 = 0 AS INTEGER) AS BIGINT) AS n FROM orders WHERE {SOUND}) SELECT n AS n_deviations, count(*) n FROM d GROUP BY 1")
def schema_deviations(t):
    """EX-13, SET-7, AGG-20b: fields missing or unknown and values of another kind."""
    # A filter on the number would work it out a second time below.
    rows = _asked(t).select(F.explode(F.filter(F.array(F.size(ex.deviations(_answer())).cast("long")), lambda x: x >= 0)).alias("n_deviations"))
    return rows.groupBy("n_deviations").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'from text' WHEN 1 THEN 'from message' WHEN 2 THEN 'author ' || page_id END said, CASE WHEN page_id % 5 = 0 THEN 'fb:' || page_id ELSE 'at:' || page_id || ':' || sha256(url)[1:12] END AS post_id FROM pages")
def raw_items(t):
    """EX-17, PRJ-6, PRJ-7: the first key that is not blank, a nested author, and an identity by id, else by place and hash."""
    k = F.col("page_id")
    item = F.struct(F.when(k % 4 == 0, "from text").otherwise(" ").alias("text"), F.when(k % 4 == 1, "from message").alias("message"), F.struct(F.when(k % 4 == 2, F.concat(F.lit("author "), k.cast("string"))).alias("name")).alias("user"))
    rows = t.pages.select("page_id", "url", item.alias("item"), F.when(k % 5 == 0, k.cast("string")).alias("own_id"))
    return rows.select(
        "page_id", rc.first_text(F.col("item.text"), F.col("item.message"), F.col("item.user.name")).alias("said"),
        F.coalesce(F.concat(F.lit("fb:"), "own_id"), F.concat(F.lit("at:"), k.cast("string"), F.lit(":"), rc.short_hash(F.col("url"), 12))).alias("post_id"),
    )


@query("SELECT o_orderpriority, count(*) calls, sum(o_orderkey % 700) tokens_in, sum(o_orderkey % 90) tokens_out, round(sum(o_orderkey % 700) * 0.15 / 1e6 + sum(o_orderkey % 90) * 0.6 / 1e6, 8) AS cost, CAST(floor(median(o_orderkey % 977)) AS BIGINT) AS latency FROM orders GROUP BY 1")
def token_usage(t):
    """EX-22, FN-25, AGG-7: tokens, cost, and the whole-number median of latencies."""
    k = F.col("o_orderkey")
    rows = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("calls"), F.sum(k % 700).alias("tokens_in"), F.sum(k % 90).alias("tokens_out"), F.median(k % 977).alias("m"))
    return rows.select("o_orderpriority", "calls", "tokens_in", "tokens_out", F.round(F.col("tokens_in") * 0.15 / 1e6 + F.col("tokens_out") * 0.6 / 1e6, 8).alias("cost"), F.floor("m").alias("latency"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN upper(replace(code, '-', '')) ELSE replace(code, ' ', '') END normal, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'PL' ELSE 'CZ_SK' END countries FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x' || p_size WHEN 1 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(p_size AS VARCHAR), 2, '0') END code FROM part)")
def postcode_shapes(t):
    """GEO-2, GEO-3, GEO-4, EX-5."""
    k, size = F.col("p_partkey"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    rest = F.lpad((k % 1000).cast("string"), 3, "0")
    code = F.when(k % 3 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).when(k % 3 == 1, F.concat_ws("-", size, rest)).otherwise(F.concat_ws(" ", rest, size))
    return t.part.select("p_partkey", ex.code_ok(code).alias("normal"), F.array_join(ex.countries_by_shape(code), ",").alias("countries"))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"value\":' || CAST(round(value) AS BIGINT) || '}' AS line FROM events")
def verdict_json(t):
    """PRJ-9: one line, keys in order."""
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.round("value").cast("long").alias("value"))).alias("line"))


@query("SELECT doc_id, length(text) <= 4000 AND n_chars BETWEEN 1 AND 1000000 AS valid, NOT coalesce(lower(trim(source)) IN ('', 'null', 'none'), true) AS has_source FROM documents")
def input_constraints(t):
    """FLT-18, EX-3."""
    return t.documents.select("doc_id", ((F.length("text") <= 4000) & F.col("n_chars").between(1, 1_000_000)).alias("valid"), tx.text_or_null(F.col("source")).isNotNull().alias("has_source"))


@query()
def postcodes_found(t):
    """GEO-6 to GEO-9: postcodes in texts with their countries; checked on fixtures, as spans and windows are no SQL."""
    ship(t.spark)
    return t.documents.select("doc_id", places.found_codes("text").alias("codes")).select("doc_id", F.size("codes").alias("n_codes"), F.concat_ws("|", F.transform("codes", lambda c: F.concat_ws(" ", c["country"], c["code"]))).alias("codes"))


@query()
def stated_distances(t):
    """GEO-16: the distance that a text states for its route; checked on fixtures."""
    ship(t.spark)
    return t.documents.select("doc_id", places.stated_km("text").alias("km"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_acctbal WHEN 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) WHEN 'FURNITURE' THEN CAST(c_custkey AS DOUBLE) WHEN 'HOUSEHOLD' THEN NULL ELSE c_acctbal END AS used, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'HOUSEHOLD' THEN '' ELSE c_mktsegment END AS plan FROM customer""")
def values_at_any_depth(t):
    """EX-18, FN-33: the first number and text under a name, the least deep first."""
    kind, money, key, nation = F.col("c_mktsegment"), F.col("c_acctbal").cast("string"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    answer = (
        F.when(kind == "AUTOMOBILE", F.format_string('{"z":{"deep":{"used":%s}},"a":[{"used":"7"},[{"used":null}]],"plan":" ","b":{"plan":%s}}', money, quoted(kind)))
        .when(kind == "BUILDING", F.format_string('{"z":[{"used":true},{"x":{"used":9}},{"limit":%s}],"plan":%s}', nation, quoted(F.col("c_name"))))
        .when(kind == "FURNITURE", F.format_string('[{"y":{"used":1}},{"limit":%s,"plan":%s}]', key, quoted(kind)))
        .when(kind == "HOUSEHOLD", '{"used":{"x":[]},"plan":5')
        .otherwise(F.format_string('{"q":{"used":%s,"limit":3},"p":{"used":1},"plan":%s}', money, quoted(kind)))
    )
    return t.customer.select("c_custkey", rc.number_anywhere(answer, ["used", "limit"]).alias("used"), rc.text_anywhere(answer, "plan").alias("plan"))
