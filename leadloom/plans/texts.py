"""Queries over texts: normal form, gate, languages, codes, URLs and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gate, geo, stats
from ..operators import leads as ld
from ..params import DEFAULT
from .registry import query

SAMPLE = gate.Dictionary([gate.SAMPLE])
PUNCTUATION = "!?.,;:*#$%&-"


def _normal_sql(c: str) -> str:
    out = f"translate(lower({c}), '{tx.ACCENTED}', '{tx.PLAIN}')"
    for mark in PUNCTUATION:
        out = f"regexp_replace({out}, '[{mark}][{mark}]+', '{mark}', 'g')"
    return rf"trim(regexp_replace({out}, '[ \t\n\r]+', ' ', 'g'))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(patterns: list[str]) -> str:
    return f"regexp_matches(t, {_quoted('|'.join(map(gate.compiled, patterns)))})"


def _first_sql(patterns: list[str]) -> str:
    if not patterns:
        return "NULL"
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {_quoted(gate.compiled(p))}) THEN {_quoted(p)}" for p in patterns) + " END"


CODES_SQL = r"list_distinct(list_transform(regexp_extract_all(t, '(\b\d{2}-\d{3}\b|\b\d{3} \d{2}\b|\b\d{5}\b)'), lambda c: regexp_replace(c, '[ -]', '', 'g')))"
SCORE_SQL = " + ".join(f"CASE WHEN regexp_matches(t, {_quoted(gate.compiled(r.pattern))}) THEN {r.weight} ELSE 0 END" for r in gate.SAMPLE.scores) + f" + CASE WHEN len({CODES_SQL}) >= 2 THEN 4 ELSE 0 END"
NORMAL_CTE = f"n AS (SELECT doc_id, text, {_normal_sql('text')} t FROM documents)"
GATE_CTE = f"""{NORMAL_CTE}, l AS (SELECT doc_id, text, {_first_sql(gate.SAMPLE.extinguish)} e, {_first_sql(gate.SAMPLE.accept)} a, {_first_sql(gate.SAMPLE.reject)} r, CAST({SCORE_SQL} AS INTEGER) points FROM n),
g AS (SELECT doc_id, CASE WHEN e IS NOT NULL THEN 'extinguish' WHEN a IS NOT NULL THEN 'accept' WHEN r IS NOT NULL THEN 'reject' WHEN length(trim(text)) < 15 THEN 'short' ELSE 'score' END layer, coalesce(e, a, r) rule, points FROM l),
v AS (SELECT doc_id, layer, rule, points, CASE layer WHEN 'accept' THEN true WHEN 'score' THEN points >= 5 ELSE false END verdict FROM g)"""
JUDGED_SQL = GATE_CTE + ", j AS (SELECT v.*, quality FROM v JOIN labels USING (doc_id))"


def _score_sql(pack: gate.RulePack) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN regexp_matches(t, {_quoted(gate.compiled(r.pattern))}) THEN {r.weight} ELSE 0 END" for r in pack.scores) + f" + CASE WHEN len({CODES_SQL}) >= 2 THEN 4 ELSE 0 END AS INTEGER)"


def _packs_sql() -> str:
    """x: a row for each document and pack with what its layers say; best: the pack that wins."""
    one = [
        f"SELECT doc_id, text, lang, {k} k, '{p.name}' pack, {_first_sql(p.extinguish)} e, {_first_sql(p.accept)} a, {_first_sql(p.reject)} r, {_score_sql(p)} points FROM m"
        for k, p in enumerate(gate.PACKS)
    ]
    return f"""m AS (SELECT doc_id, text, lang, {_normal_sql('text')} t FROM documents), x AS ({' UNION ALL '.join(one)}),
y AS (SELECT *, CASE WHEN e IS NOT NULL THEN 'extinguish' WHEN a IS NOT NULL THEN 'accept' WHEN r IS NOT NULL THEN 'reject' WHEN length(trim(text)) < 15 THEN 'short' ELSE 'score' END layer, coalesce(e, a, r) rule FROM x),
z AS (SELECT *, CASE layer WHEN 'accept' THEN true WHEN 'score' THEN points >= 5 ELSE false END verdict FROM y),
best AS (SELECT doc_id, layer, rule, points, verdict FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY verdict DESC, (rule IS NOT NULL) DESC, CASE WHEN verdict THEN points ELSE -points END DESC, (lang = pack) DESC, k) = 1)"""


#: Words a language in the packs that the corpus gives, and the ranks of those that end a search.
PACK_WORDS, LAST_RANKS = 200, {198: "extinguish", 199: "accept", 200: "reject"}
WORD_PACKS = f"""m AS (SELECT doc_id, text, lang, {_normal_sql('text')} t FROM documents), u AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(t, '[^a-z0-9]+')) w FROM m), c AS (SELECT lang, w, count(*) n FROM u WHERE regexp_full_match(w, '[a-z]{{3,}}') AND lang IS NOT NULL GROUP BY ALL),
term AS (SELECT lang pack, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) rank FROM c QUALIFY rank <= {PACK_WORDS}), pack AS (SELECT pack, row_number() OVER (ORDER BY pack) k FROM (SELECT DISTINCT pack FROM term)),
h AS (SELECT u.doc_id, pack, any_value(u.w) FILTER (rank = 198) e, any_value(u.w) FILTER (rank = 199) a, any_value(u.w) FILTER (rank = 200) r, sum(CASE WHEN rank >= 198 THEN 0 WHEN rank % 3 = 0 THEN -1 WHEN rank <= 50 THEN 1 ELSE 2 END) s FROM u JOIN term USING (w) GROUP BY ALL),
x AS (SELECT m.doc_id, text, lang, k, p.pack, e, a, r, CAST(coalesce(s, 0) + CASE WHEN len({CODES_SQL}) >= 2 THEN 4 ELSE 0 END AS INTEGER) points FROM m CROSS JOIN pack p LEFT JOIN h ON h.doc_id = m.doc_id AND h.pack = p.pack)"""
BEST = """y AS (SELECT *, CASE WHEN e IS NOT NULL THEN 'extinguish' WHEN a IS NOT NULL THEN 'accept' WHEN r IS NOT NULL THEN 'reject' WHEN length(trim(text)) < 15 THEN 'short' ELSE 'score' END layer, coalesce(e, a, r) rule FROM x),
z AS (SELECT *, CASE layer WHEN 'accept' THEN true WHEN 'score' THEN points >= 5 ELSE false END verdict FROM y),
best AS (SELECT doc_id, layer, rule, points, verdict FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY verdict DESC, (rule IS NOT NULL) DESC, CASE WHEN verdict THEN points ELSE -points END DESC, (lang = pack) DESC, k) = 1)"""


def frequent_words(docs, most: int = PACK_WORDS):
    """lang, w and rank of each language's most frequent words of three letters and more; ranked in parts before the whole."""
    words = docs.where("lang is not null").select("lang", F.explode(F.array_distinct(F.split(tx.normal(F.col("text")), "[^a-z0-9]+"))).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    for parts in (["lang", F.crc32(F.col("w").cast("binary")) % 64], ["lang"]):
        counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc("n"), "w"))).where(F.col("rank") <= most)
    return counts.select("lang", "w", "rank")


@query(f"WITH {WORD_PACKS}, {BEST} SELECT * FROM best")
def gate_dictionaries(t):
    """GT-2 to GT-5: a pack of 200 terms for each language, rows of a table, looked up by one automaton."""
    rank = F.col("rank")
    layer = F.coalesce(F.create_map(*(F.lit(x) for pair in LAST_RANKS.items() for x in pair))[rank], F.lit("scores"))
    weight = F.when(rank % 3 == 0, -1).when(rank <= 50, 1).otherwise(2)
    terms = frequent_words(t.documents).select(F.col("lang").alias("pack"), rank.alias("place"), layer.alias("layer"), F.col("w").alias("term"), weight.alias("weight"), F.lit("WORD").alias("label"), F.lit("").alias("unless"))
    return gate.resolved(t.documents, gate.packs_of(terms), lang="lang").select("doc_id", "layer", "rule", "points", "verdict")


@query(f"WITH {_packs_sql()} SELECT * FROM best")
def gate_resolved(t):
    """GT-3, GT-5: the best verdict of four language packs."""
    return gate.resolved(t.documents, gate.PACKS, lang="lang").select("doc_id", "layer", "rule", "points", "verdict")


@query(f"""WITH {_packs_sql()}, s AS (SELECT doc_id, min_by(e, k) FILTER (e IS NOT NULL) stop FROM x GROUP BY 1), d AS (SELECT doc_id, ({_any_sql([p for x in gate.PACKS for p in x.demand])} OR contains(t, '?')) w, {_any_sql([p for x in gate.PACKS for p in x.offer])} o FROM m),
f AS (SELECT doc_id, CASE WHEN w AND NOT o THEN 'demand' WHEN o AND NOT w THEN 'offer' ELSE 'unclear' END direction, stop, layer, rule, points, verdict FROM best JOIN s USING (doc_id) JOIN d USING (doc_id))
SELECT doc_id, CASE WHEN direction = 'offer' THEN 'offer' WHEN stop IS NOT NULL THEN 'extinguish' ELSE layer END layer, CASE WHEN direction <> 'offer' THEN coalesce(stop, rule) END rule, points, direction <> 'offer' AND stop IS NULL AND verdict AS verdict, direction, true AS passes FROM f""")
def gate_orchestrated(t):
    """GT-6, GT-15: offers and extinguishing rules first, then the packs; in shadow mode all pass."""
    return gate.orchestrated(t.documents, gate.PACKS, lang="lang", shadow=True).select("doc_id", "layer", "rule", "points", "verdict", "direction", "passes")


@query("WITH m AS (SELECT doc_id, " + _normal_sql("text") + " t FROM documents) SELECT label, count(*) n FROM (" + " UNION ALL ".join(f"SELECT {_quoted(f'{r.label}:{r.pattern}({r.weight:+d})')} AS label FROM m WHERE regexp_matches(t, {_quoted(gate.compiled(r.pattern))})" for r in gate.SAMPLE.scores) + ") GROUP BY label")
def gate_hit_labels(t):
    """GT-12."""
    rows = gate.bound(t.documents, "text", SAMPLE).select(F.explode(SAMPLE.labels(F.col(gate.HITS), 0)).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def _judged(t):
    return gate.evaluate(t.documents.join(t.labels.select("doc_id", "quality"), "doc_id")).select("doc_id", "layer", "rule", "points", "verdict", "quality")


@query(f"WITH {NORMAL_CTE} SELECT doc_id, CAST({SCORE_SQL} AS INTEGER) points FROM n")
def gate_score(t):
    return gate.bound(t.documents.select("doc_id", "text"), "text", SAMPLE).select("doc_id", gate.score(SAMPLE, 0).alias("points"))


@query(f"WITH {GATE_CTE} SELECT * FROM v")
def gate_layers(t):
    return gate.evaluate(t.documents).select("doc_id", "layer", "rule", "points", "verdict")


@query(f"WITH {JUDGED_SQL} SELECT count(*) FILTER (verdict AND quality=1) tp, count(*) FILTER (verdict AND quality<>1) fp, count(*) FILTER (NOT verdict AND quality=1) fn, count(*) FILTER (NOT verdict AND quality<>1) tn FROM j")
def confusion_matrix(t):
    return stats.confusion(_judged(t), "verdict", "quality")


@query(f"WITH {JUDGED_SQL}, s AS (SELECT threshold, quality, CASE WHEN layer='score' THEN points >= threshold ELSE verdict END w FROM j, range(16) r(threshold)) SELECT threshold, count(*) FILTER (NOT w) rejected, count(*) FILTER (NOT w AND quality=1) fn, round(100.0::DOUBLE * count(*) FILTER (NOT w) / count(*), 2) pct FROM s GROUP BY threshold")
def threshold_sweep(t):
    return stats.sweep(_judged(t), "quality")


@query(f"WITH {JUDGED_SQL}, h AS (SELECT points, count(*) n, count(*) FILTER (verdict) n_pass FROM j GROUP BY points) SELECT points, n, n_pass, repeat('#', CAST(ceil(n * 40 / (SELECT max(n) FROM h)) AS INTEGER)) bar FROM h")
def score_histogram(t):
    return stats.histogram(_judged(t), "points", "verdict")


@query(f"WITH {GATE_CTE} SELECT coalesce(rule, CASE WHEN layer = 'score' THEN 'points' ELSE layer END) reason, count(*) n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM v WHERE NOT verdict GROUP BY 1")
def reject_reasons(t):
    rows = gate.evaluate(t.documents).where("not verdict").select(F.coalesce("rule", F.when(F.col("layer") == "score", "points").otherwise(F.col("layer"))).alias("reason"))
    return stats.shares(rows, "reason")


@query(f"WITH {JUDGED_SQL} SELECT count(*) n, count(*) FILTER (NOT verdict AND quality=1) fn, count(*) >= 200 AND count(*) FILTER (NOT verdict AND quality=1) = 0 AS ready FROM j")
def readiness(t):
    n, fn = F.count("*"), F.count_if(~F.col("verdict") & (F.col("quality") == 1))
    return _judged(t).agg(n.alias("n"), fn.alias("fn"), ((n >= 200) & (fn == 0)).alias("ready"))


@query(f"WITH {NORMAL_CTE}, d AS (SELECT doc_id, ({_any_sql(gate.SAMPLE.demand)} OR contains(t, '?')) w, {_any_sql(gate.SAMPLE.offer)} o FROM n) SELECT doc_id, CASE WHEN w AND NOT o THEN 'demand' WHEN o AND NOT w THEN 'offer' ELSE 'unclear' END direction FROM d")
def direction_signal(t):
    return gate.bound(t.documents.select("doc_id", "text"), "text", SAMPLE).select("doc_id", gate.direction(SAMPLE).alias("direction"))


@query(f"WITH {NORMAL_CTE} SELECT doc_id, CASE WHEN {_any_sql(gate.SAMPLE.reject)} THEN 'animal' WHEN {_any_sql(['with', 'that'])} THEN 'vehicle' ELSE 'other' END category FROM n")
def cargo_category(t):
    words = gate.Dictionary([gate.RulePack("cargo", reject=gate.SAMPLE.reject, accept=["with", "that"])])
    hits = F.col(gate.HITS)
    return gate.bound(t.documents.select("doc_id", "text"), "text", words).select("doc_id", F.when(words.any_of(hits, "reject"), "animal").when(words.any_of(hits, "accept"), "vehicle").otherwise("other").alias("category"))


def _language_sql() -> str:
    parts = []
    for lang, letters in tx.MARKERS.items():
        own = " + ".join([f"CASE WHEN contains(lower(text), '{c}') THEN 3 ELSE 0 END" for c in letters] + ["0"])
        words = ", ".join(f"'{w}'" for w in tx.FUNCTION_WORDS[lang])
        parts.append(rf"({own}) + 2 * len(list_intersect(regexp_split_to_array(lower(text), '[ \t\n\r.,;:!?|]+'), [{words}])) AS s_{lang}")
    return "s AS (SELECT doc_id, lang, " + ", ".join(parts) + " FROM documents), k AS (SELECT doc_id, lang, list_sort([" + ", ".join(f"{{'s': -s_{x}, 'l': '{x}'}}" for x in tx.MARKERS) + "]) r FROM s), d AS (SELECT doc_id, lang, CASE WHEN r[1].s < 0 AND r[2].s - r[1].s >= 2 THEN r[1].l ELSE '' END found FROM k)"


@query(f"WITH {_language_sql()} SELECT doc_id, found FROM d")
def language_detect(t):
    return t.documents.select("doc_id", tx.language(F.col("text")).alias("found"))


@query(f"WITH {_language_sql()} SELECT lang, count(*) n, count(*) FILTER (found = lang) n_right, round(count(*) FILTER (found = lang) / count(*), 4) accuracy FROM d GROUP BY lang")
def language_accuracy(t):
    rows = t.documents.select("lang", tx.language(F.col("text")).alias("found"))
    right = F.count_if(F.col("found") == F.col("lang"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), right.alias("n_right"), F.round(right / F.count("*"), 4).alias("accuracy"))


@query(f"WITH {NORMAL_CTE} SELECT doc_id, sha256(t)[1:16] content_id FROM n")
def text_normalize_hash(t):
    return t.documents.select("doc_id", tx.content_id(tx.normal(F.col("text"))).alias("content_id"))


@query("SELECT min(doc_id) doc_id, count(*) copies, sha256(text)[1:16] content_id FROM documents GROUP BY text")
def content_dedup_first(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", F.substring("h", 1, 16).alias("content_id"))


@query(f"SELECT doc_id, len({CODES_SQL}) n_codes FROM (SELECT doc_id, text t FROM documents)")
def distinct_codes_in_text(t):
    return t.documents.select("doc_id", F.size(tx.postcodes(F.col("text"))).cast("long").alias("n_codes"))


PHONE_SQL = r"nullif(regexp_replace(regexp_extract(text, '(\d(?:[ .()-]?\d){8,14})', 1), '[^0-9]', '', 'g'), '')"


@query(f"SELECT doc_id, {PHONE_SQL} IS NOT NULL AS has_phone FROM documents")
def phone_flag(t):
    return t.documents.select("doc_id", tx.first_phone(F.col("text")).isNotNull().alias("has_phone"))


@query(rf"WITH p AS (SELECT doc_id, {PHONE_SQL} d FROM documents), q AS (SELECT doc_id, CASE WHEN starts_with(d, '00') THEN d[3:22] ELSE d END d FROM p WHERE d IS NOT NULL), r AS (SELECT doc_id, CASE WHEN (starts_with(d,'420') OR starts_with(d,'421')) AND length(d) >= 12 THEN d[4:23] WHEN (starts_with(d,'48') OR starts_with(d,'49')) AND length(d) >= 11 THEN d[3:22] ELSE d END phone FROM q) SELECT doc_id, phone, trim(regexp_replace(phone, '(.{{3}})', '\1 ', 'g')) pretty FROM r")
def phone_normalize(t):
    rows = t.documents.select("doc_id", tx.first_phone(F.col("text")).alias("d")).where("d is not null").select("doc_id", tx.phone_normal(F.col("d")).alias("phone"))
    return rows.withColumn("pretty", tx.phone_pretty(F.col("phone")))


URL_SQL = "'https://' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '^[a-z]+://', ''), '^(www|m)\\.', ''), '/+$', '')"


@query(f"SELECT {URL_SQL} AS canonical, count(*) n, min(page_id) first_id FROM pages GROUP BY 1")
def url_canonical(t):
    return t.pages.groupBy(tx.url_canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


@query("SELECT page_id, regexp_extract(lower(url), '^[a-z]+://[^/]+/([^/?#]+)', 1) group_key FROM pages")
def url_group_key(t):
    return t.pages.select("page_id", tx.url_group_key(F.col("url")).alias("group_key"))


@query("SELECT event_id, greatest(0, least(100, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0))) k FROM events")
def lenient_json(t):
    answer = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    found = F.from_json(tx.lenient_json(answer), "k int")
    return t.events.select("event_id", tx.confidence(found["k"]).alias("k"))


@query("SELECT event_id, CASE WHEN event_type IN ('view','click') THEN event_type ELSE 'other' END kind, event_type = 'click' AS clicked FROM events")
def enum_clamp(t):
    return t.events.select("event_id", tx.clamp_enum(F.upper("event_type"), ["view", "click"], "other").alias("kind"), (F.col("event_type") == "click").alias("clicked"))


@query("SELECT o_orderkey, '{\"o_orderstatus\":\"' || o_orderstatus || '\"' || CASE WHEN o_totalprice > 1000 THEN ',\"price\":' || o_totalprice ELSE '' END || '}' AS doc FROM orders")
def nested_strip_nulls(t):
    return t.orders.select("o_orderkey", F.to_json(F.struct("o_orderstatus", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"))).alias("doc"))


@query("SELECT doc_id, quality IS NULL AND toxic IS NULL AS empty FROM documents LEFT JOIN labels USING (doc_id)")
def empty_extraction(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", (F.col("quality").isNull() & F.col("toxic").isNull()).alias("empty"))


@query("WITH m AS (SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 60) AS BIGINT) m FROM events) SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN m // 60 || ' h' ELSE m // 1440 || ' d' END age FROM m")
def relative_age(t):
    return t.events.select("event_id", tx.relative_age(F.col("ts").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")).alias("age"))


@query("WITH d AS (SELECT doc_id, lower(text) t FROM documents), b AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: CASE WHEN length(x) > 5 THEN x[1:length(x)-2] ELSE x END), lambda x: length(x) >= 4)) s FROM benchmark) SELECT item_id, count(*) n_docs, count(*) FILTER (NOT list_bool_and(list_transform(s, lambda x: contains(t, x)))) n_missing FROM b, d GROUP BY item_id")
def hallucination_rate(t):
    """AGG-20, EX-14, EX-15: all items with all their stems."""
    words = F.split(F.lower("text"), "[^a-z]+")
    stems = F.array_distinct(F.filter(F.transform(words, lambda x: F.when(F.length(x) > 5, F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x)), lambda x: F.length(x) >= 4))
    return stats.missing_names(t.documents, t.benchmark.select("item_id", stems.alias("stems")))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(p_name, ' ')) w FROM part), p AS (SELECT w[1:length(w)-g] q, w FROM w, range(1,4) r(g) WHERE length(w) - g >= 5) SELECT q AS word, min(w) AS name FROM p WHERE q IN (SELECT w[1:5] FROM w) GROUP BY q HAVING count(DISTINCT w) = 1")
def prefix_match_unique(t):
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("name"))
    return geo.unique_prefix(names.select(F.substring("name", 1, 5).alias("word")), names)


PLACES = "(VALUES (0, 52.2297::DOUBLE, 21.0122::DOUBLE), (1, 50.0647, 19.9450), (2, 48.8566, 2.3522), (3, 40.4168, -3.7038), (4, NULL, NULL)) p(k, lat, lng)"


@query(f"WITH q AS (SELECT c_custkey, a.lat la, a.lng lo, b.lat lb, b.lng l2 FROM customer JOIN {PLACES.replace(' p(', ' a(')} ON c_custkey % 5 = a.k JOIN {PLACES.replace(' p(', ' b(')} ON c_nationkey % 5 = b.k), d AS (SELECT c_custkey, CASE WHEN la + lb IS NOT NULL THEN round(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(l2 - lo) / 2), 2)))) * 1.25::DOUBLE, 1) END km FROM q) SELECT c_custkey, km, CASE WHEN km IS NOT NULL THEN round(greatest(250.0::DOUBLE, km * 4.0::DOUBLE), 0) END price FROM d")
def haversine_price(t):
    places = t.spark.createDataFrame([(0, 52.2297, 21.0122), (1, 50.0647, 19.9450), (2, 48.8566, 2.3522), (3, 40.4168, -3.7038), (4, None, None)], "k long, lat double, lng double")
    a, b = places.alias("a"), places.alias("b")
    rows = t.customer.join(F.broadcast(a), F.col("c_custkey") % 5 == F.col("a.k")).join(F.broadcast(b), F.col("c_nationkey") % 5 == F.col("b.k"))
    rows = rows.select("c_custkey", geo.road_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")).alias("km"))
    return rows.withColumn("price", geo.price(F.col("km")))


@query("WITH c AS (SELECT split_part(p_name, ' ', 1) AS name, p_brand country, p_type region, count(*) codes, sum(p_size) population FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY population DESC, codes DESC, country, region) r, lead(population) OVER (PARTITION BY name ORDER BY population DESC, codes DESC, country, region) p2, count(*) OVER (PARTITION BY name) m FROM c) SELECT name, CASE WHEN m = 1 OR population >= 3 * p2 THEN country END country, CASE WHEN m = 1 OR population >= 3 * p2 THEN region END region FROM k WHERE r = 1")
def geocode_variants(t):
    rows = t.part.groupBy(F.split("p_name", " ")[0].alias("name"), F.col("p_brand").alias("country"), F.col("p_type").alias("region")).agg(F.count("*").alias("codes"), F.sum("p_size").alias("population"))
    return geo.chosen_variant(rows.withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})).select("name", "country", "region")


@query("WITH b AS (SELECT * FROM (VALUES ('STANDARD', 1.5::DOUBLE), ('STANDARD ANODIZED', 2.5), ('PROMO', 3.0), ('E', 4.0)) v(prefix, rate)), m AS (SELECT p_partkey, arg_max(rate, length(prefix)) rate FROM part LEFT JOIN b ON starts_with(p_type, prefix) GROUP BY p_partkey) SELECT p_partkey, rate, round(rate * p_size / 1000, 6) cost FROM m JOIN part USING (p_partkey)")
def price_longest_prefix(t):
    rates = t.spark.createDataFrame([("STANDARD", 1.5), ("STANDARD ANODIZED", 2.5), ("PROMO", 3.0), ("E", 4.0)], "prefix string, rate double")
    rows = t.part.join(F.broadcast(rates), F.col("p_type").startswith(F.col("prefix")), "left")
    return rows.groupBy("p_partkey", "p_size").agg(F.max_by("rate", F.length("prefix")).alias("rate")).select("p_partkey", "rate", F.round(F.col("rate") * F.col("p_size") / 1000, 6).alias("cost"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(text[1:200], ' [^ ]*$', '') || '…' END quote FROM documents")
def quoted_text(t):
    return t.documents.select("doc_id", tx.quoted(F.col("text")).alias("quote"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(password|token|secret|api_key)=[^ \n]+', '\1=***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}', '***@***', 'g'), '\+?\d(?:[ .()-]?\d){8,14}', '***', 'g') AS masked FROM documents")
def masked_text(t):
    return t.documents.select("doc_id", tx.masked(F.col("text")).alias("masked"))


@query(f"""WITH {GATE_CTE}, d AS (SELECT doc_id, ({_any_sql(gate.SAMPLE.demand)} OR contains(t, '?')) w, {_any_sql(gate.SAMPLE.offer)} o FROM n),
f AS (SELECT o AND NOT w AS offer, v.verdict gate, coalesce(ts < TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 6 HOUR, false) AS old, CASE quality WHEN 1 THEN true WHEN 0 THEN false END model FROM v JOIN d USING (doc_id) LEFT JOIN events ON event_id = doc_id LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN offer THEN 'offer' WHEN NOT gate THEN 'gate' WHEN old THEN 'stale' WHEN model IS NULL THEN 'no_answer' WHEN model THEN 'order' ELSE 'model' END outcome, count(*) n FROM f GROUP BY 1""")
def post_decisions(t):
    """S-11, AGG-29: what becomes of documents: their direction, the gate, their event's age, and the label as the model's verdict."""
    judged = gate.bound(t.documents.select("doc_id", "text"), "text", SAMPLE)
    judged = judged.select("doc_id", gate.direction(SAMPLE).alias("direction"), gate.judged(SAMPLE, 0, F.col("text"), DEFAULT.gate_threshold)["verdict"].alias("gate"))
    rows = judged.join(t.events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts")), "doc_id", "left").join(t.labels, "doc_id", "left")
    model = F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False)
    found = ld.decision(F.col("direction"), F.col("gate"), ld.stale(F.col("ts"), F.lit("2024-01-16").cast("timestamp")), model)
    return rows.groupBy(found.alias("outcome")).agg(F.count("*").alias("n"))
