"""The engine's registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import entropy, hashing, text
from gneiss.operators import diff, intervals, rules, summaries, survey, versions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hashing, entropy, text ---------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def text_digests(spark, d):
    return _t(spark, d, "documents").select("doc_id", hashing.digests(F.col("text")).alias("x")).select("doc_id", "x.*")


_BYTES = """
h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, (k // 4096) AS w, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT AS v FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS k FROM h)),
c AS (SELECT doc_id, w, v, count(*) AS n FROM b GROUP BY ALL)"""


@query(f"""WITH {_BYTES},
p AS (SELECT doc_id, v, sum(n) AS n FROM c GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS t FROM p GROUP BY ALL)
SELECT doc_id, round(-sum((n / t) * log2(n / t)) + 0.0, 6) AS entropy FROM p JOIN t USING (doc_id) GROUP BY doc_id""")
def byte_entropy(spark, d):
    return _t(spark, d, "documents").where("text <> ''").select("doc_id", F.round(entropy.bits(F.col("text")), 6).alias("entropy"))


@query(f"""WITH {_BYTES},
t AS (SELECT doc_id, w, sum(n) AS t FROM c GROUP BY ALL),
e AS (SELECT doc_id, w, -sum((n / t) * log2(n / t)) AS e FROM c JOIN t USING (doc_id, w) GROUP BY ALL),
m AS (SELECT doc_id, avg(e) AS mean FROM e GROUP BY ALL),
p AS (SELECT doc_id, v, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS t, count(*) AS kinds, sum(CASE WHEN v BETWEEN 32 AND 126 OR v IN (9, 10, 13) THEN n ELSE 0 END) AS pr FROM p GROUP BY ALL)
SELECT doc_id, round(mean + 0.0, 6) AS mean_entropy,
 CASE WHEN t < 256 THEN 'unknown' WHEN kinds = 1 THEN 'erased' WHEN mean < 1.5 THEN 'sparse' WHEN pr / t >= 0.85 THEN 'text' WHEN mean < 7.2 THEN 'binary' ELSE 'packed' END AS class
FROM m JOIN s USING (doc_id)""")
def entropy_class(spark, d):
    p = _t(spark, d, "documents").where("text <> ''").select("doc_id", entropy.profile(F.col("text").cast("binary"), None).alias("p"))
    return p.select("doc_id", F.round(F.col("p.mean"), 6).alias("mean_entropy"), entropy.classify(F.col("p")).alias("class"))


@query("SELECT doc_id, NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS clean FROM documents")
def clean_text_flag(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.is_clean(F.col("text")).alias("clean"))


_SAFE = """regexp_replace(regexp_replace(regexp_replace({}, '[\\x00-\\x1f\\x7f/\\\\:*?"<>|]', '_', 'g'), '_+', '_', 'g'), '^\\.+', '')"""


@query(f"""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN regexp_matches(s, '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\\..*)?$') THEN s || '_' ELSE s END AS name
FROM (SELECT page_id, regexp_replace(substr({_SAFE.format('url')}, 1, 64), '[. ]+$', '') AS s FROM pages)""")
def safe_filename(spark, d):
    return _t(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS raw FROM pages),
s AS (SELECT page_id, raw, list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, CASE WHEN raw = '' OR len(parts) = 0 THEN 'empty' WHEN raw LIKE '/%' THEN 'absolute' WHEN list_contains(parts, '..') THEN 'dotdot' END AS why,
 CASE WHEN raw <> '' AND raw NOT LIKE '/%' AND NOT list_contains(parts, '..') AND len(parts) > 0 THEN array_to_string(parts, '/') END AS path FROM s""")
def normalize_path(spark, d):
    raw = F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    return _t(spark, d, "pages").select("page_id", text.normalize_path(raw).alias("x")).select("page_id", "x.path", "x.why")


# --- rules --------------------------------------------------------------------------------------


def _items(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("item"), F.lit("documents").alias("node"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.lit(False).alias("region")
    )


def _matches(spark, d, rule: str, core: str) -> DataFrame:
    """All matches of one rule, cut to the part that the pattern means."""
    chosen = [r for r in rules.builtin() if r.id == rule]
    hits = rules.sweep(_items(spark, d), chosen, max_hits=None, max_item_bytes=None, per_rule=None)
    return hits.groupBy(F.col("item").alias("doc_id"), F.regexp_extract("match", core, 0).alias("match")).agg(F.count("*").alias("n"))


def _matches_sql(pattern: str, core: str, check: str = "true") -> str:
    return f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM documents)
SELECT doc_id, regexp_extract(m, '{core}') AS match, count(*) AS n FROM m WHERE {check} GROUP BY ALL"""


_PATTERN = {r.id: r.pattern for r in rules.builtin()}
_LUHN = """(len(regexp_replace(m, '[^0-9]', '', 'g')) >= 12 AND len(list_distinct(string_split(m, ''))) > 1 AND
 list_sum(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN (len(m) - k) % 2 = 0 THEN m[k]::INT ELSE 2 * m[k]::INT - 9 * (m[k]::INT > 4)::INT END)) % 10 = 0)"""


@query(_matches_sql(_PATTERN["email"], ".*"))
def rule_hits_email(spark, d):
    return _matches(spark, d, "email", ".*")


@query(_matches_sql(_PATTERN["ipv4"], "[0-9.]+"))
def rule_hits_ipv4(spark, d):
    return _matches(spark, d, "ipv4", "[0-9.]+")


@query(_matches_sql(_PATTERN["payment-card"], "[0-9]+", _LUHN))
def rule_hits_card(spark, d):
    return _matches(spark, d, "payment-card", "[0-9]+")


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{12,19}}')) AS m FROM documents) SELECT doc_id, m AS digits, {_LUHN} AS valid FROM m""")
def luhn_cards(spark, d):
    found = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{12,19}"), F.lit(0))).alias("digits"))
    return found.select("doc_id", "digits", rules.luhn_column(F.col("digits")).alias("valid"))


def _pii(spark, d) -> DataFrame:
    return rules.sweep(_items(spark, d), [r for r in rules.builtin("pii", "network") if r.id in ("email", "ipv4", "payment-card")], max_hits=None, max_item_bytes=None, per_rule=None)


_PII_SQL = f"""m AS (SELECT doc_id, 'pii' AS pack, 'email' AS rule, 'pii' AS category, 'medium' AS severity, unnest(regexp_extract_all(text, '{_PATTERN["email"]}')) AS m FROM documents
 UNION ALL SELECT * FROM (SELECT doc_id, 'pii', 'payment-card', 'pii', 'critical', unnest(regexp_extract_all(text, '{_PATTERN["payment-card"]}')) AS m FROM documents) WHERE {_LUHN}
 UNION ALL SELECT doc_id, 'network', 'ipv4', 'network', 'low', unnest(regexp_extract_all(text, '{_PATTERN["ipv4"]}')) AS m FROM documents)"""


@query(f"""WITH {_PII_SQL}, g AS (SELECT doc_id, pack, rule, count(*) AS hits FROM m GROUP BY ALL)
SELECT doc_id, pack, rule, hits, row_number() OVER (PARTITION BY pack, rule ORDER BY hits DESC, doc_id) AS place FROM g QUALIFY place <= 10""")
def sweep_top_hits(spark, d):
    n = _pii(spark, d).groupBy(F.col("item").alias("doc_id"), "pack", "rule").agg(F.count("*").alias("hits"))
    order = W.partitionBy("pack", "rule").orderBy(F.col("hits").desc(), "doc_id")
    return n.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 10")


@query(f"""WITH {_PII_SQL}, g AS (SELECT rule, category, severity, count(*) AS hits, grouping(rule) AS gr, grouping(category) AS gc FROM m GROUP BY GROUPING SETS ((rule), (category), (severity)))
SELECT CASE WHEN gr = 0 THEN 'rule' WHEN gc = 0 THEN 'category' ELSE 'severity' END AS "by", coalesce(rule, category, severity) AS value, hits FROM g""")
def sweep_summary(spark, d):
    return rules.summary(_pii(spark, d))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE regexp_matches(path, '^([^/]*/)*en/[^/]*$')""")
def glob_path_match(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return _t(spark, d, "pages").select("page_id", path.alias("path")).where(F.col("path").rlike(text.glob_regex("**/en/*")))


@query("""SELECT page_id, 'script' AS signature, (strlen(substr(html, 1, strpos(html, '<script>') - 1)))::BIGINT AS first_offset, ((length(html) - length(replace(html, '<script>', ''))) // 8)::BIGINT AS hits FROM pages WHERE contains(html, '<script>')
UNION ALL SELECT page_id, 'doctype', (strlen(substr(html, 1, strpos(html, '<!DOCTYPE') - 1)))::BIGINT, ((length(html) - length(replace(html, '<!DOCTYPE', ''))) // 9)::BIGINT FROM pages WHERE contains(html, '<!DOCTYPE')""")
def magic_scan(spark, d):
    from gneiss.operators import discovery

    blobs = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.lit(0).cast("long").alias("chunk_off"), F.octet_length("html").cast("long").alias("core_len"), F.col("html").cast("binary").alias("content"))
    signatures = [discovery.Signature("script", "html", "other", b"<script>"), discovery.Signature("doctype", "html", "other", b"<!DOCTYPE")]
    hits = discovery.magic_hits(blobs, signatures)
    return hits.groupBy(F.col("source_id").cast("long").alias("page_id"), "signature").agg(F.min("offset").alias("first_offset"), F.count("*").alias("hits"))


# --- intervals ----------------------------------------------------------------------------------


def _claims(spark, d) -> DataFrame:
    """Events as claims of a user's line: from the event's second on, as many seconds as its value."""
    off = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", off.alias("off"), F.floor("value").cast("long").alias("value"))
    return e.withColumn("stop", F.col("off") + F.greatest(F.col("value"), F.lit(0)))


_CLAIMS = "e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000)::BIGINT AS off, floor(value)::BIGINT AS value FROM events), cl AS (SELECT *, off + greatest(value, 0) AS stop FROM e)"


@query(f"""WITH {_CLAIMS}, r AS (SELECT user_id, off, stop FROM cl WHERE stop > off),
w AS (SELECT user_id, off, greatest(coalesce(max(stop) OVER (PARTITION BY user_id ORDER BY off, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS seen FROM r),
t AS (SELECT user_id, coalesce(max(CASE WHEN stop > off THEN stop END), 0) AS gap_off, max(off) + 100000 AS gap_end FROM cl GROUP BY user_id)
SELECT user_id, seen AS gap_off, off AS gap_end FROM w WHERE off - seen >= 4096 UNION ALL SELECT * FROM t WHERE gap_end - gap_off >= 4096""")
def interval_gaps(spark, d):
    return intervals.gaps(_claims(spark, d).select("user_id", "off", "stop"), ["user_id"], F.max("off") + 100000)


_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"


@query(f"""WITH x AS (SELECT o_orderkey AS ord, o_custkey % 50 AS shelf, {_DAY.format('o_orderdate')} AS off, {_DAY.format('o_orderdate')} + 1 + o_orderkey % 60 AS stop FROM orders),
p AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS point, l_partkey % 50 AS shelf, {_DAY.format('l_shipdate')} AS at FROM lineitem)
SELECT p.shelf, p.point, p.at, (max(struct_pack(l := -(x.stop - x.off), ord := x.ord))).ord AS parent
FROM p LEFT JOIN x ON p.shelf = x.shelf AND p.at >= x.off AND p.at < x.stop GROUP BY ALL""")
def interval_parent(spark, d):
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 50).alias("shelf"), day("o_orderdate").alias("off"))
    o = o.withColumn("stop", F.col("off") + 1 + F.col("ord") % 60)
    p = _t(spark, d, "lineitem").select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("point"), (F.col("l_partkey") % 50).alias("shelf"), day("l_shipdate").alias("at")).distinct()
    return intervals.innermost_parent(p, o, ["shelf"], 64)


@query(f"""WITH RECURSIVE {_CLAIMS}, f AS (SELECT user_id, event_id, off AS o, greatest(value, 0) AS n, ([25, 60, 85, 99])[event_id % 4 + 1] AS c, event_type FROM cl),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, c DESC, n DESC, event_id, event_type) - 1 AS r FROM f),
w AS (SELECT user_id, event_id, r, NULL::BIGINT AS owner, CASE WHEN n > 0 THEN [{{r: r, o: o, n: n, c: c}}] ELSE []::STRUCT(r BIGINT, o BIGINT, n BIGINT, c INTEGER)[] END AS open, r AS kept, o AS kept_at FROM x WHERE r = 0
 UNION ALL SELECT user_id, event_id, r, CASE WHEN here THEN kept ELSE found.r END, CASE WHEN here THEN open WHEN found IS NULL AND n > 0 THEN list_append(still, {{r: r, o: o, n: n, c: c}}) ELSE still END,
  CASE WHEN here THEN kept WHEN found IS NULL THEN r END, CASE WHEN here THEN kept_at WHEN found IS NULL THEN o END
 FROM (SELECT *, list_filter(still, lambda y: y.c > c AND o + greatest(n, 1) <= y.o + y.n)[-1] AS found
  FROM (SELECT x.*, w.open, w.kept, w.kept_at, coalesce(w.kept_at = x.o, false) AS here, list_filter(w.open, lambda y: y.o + y.n > x.o) AS still FROM w JOIN x ON x.user_id = w.user_id AND x.r = w.r + 1)))
SELECT user_id AS image_id, printf('s%010d', event_id) AS signature, r AS place, owner FROM w""")
def conflict_resolve(spark, d):
    tier = F.element_at(F.array(*map(F.lit, (25, 60, 85, 99))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    f = _claims(spark, d).select(
        F.col("user_id").alias("image_id"), F.col("off").alias("offset"), F.greatest("value", F.lit(0)).alias("size"), tier.alias("confidence"), F.col("event_type").alias("format"),
        F.lit("other").alias("category"), F.format_string("s%010d", "event_id").alias("signature"),
    )
    return intervals.resolve(f).select("image_id", "signature", "place", "owner")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey * 100 AS start, (l_quantity * 1000)::BIGINT AS size, 1000000 AS lim FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN start >= lim THEN 0 ELSE greatest(0, least(size, lim - start)) END::BIGINT AS length, start >= lim AS outside, CASE WHEN start < lim AND start + size > lim THEN size END AS claimed_size FROM x""")
def clamp_ranges(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100).alias("start"), (F.col("l_quantity") * 1000).cast("long").alias("size"), F.lit(1_000_000).cast("long").alias("lim"))
    return intervals.clamp(x, "start", "size", "lim").select("l_orderkey", "l_linenumber", "length", "outside", "claimed_size")


@query(f"""WITH {_CLAIMS}, w AS (SELECT user_id, off, stop, event_id FROM cl WHERE stop > off),
c AS (SELECT DISTINCT user_id, x FROM (SELECT user_id, off AS x FROM w UNION ALL SELECT user_id, stop FROM w)),
p AS (SELECT * FROM (SELECT user_id, x, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS y FROM c) WHERE y IS NOT NULL),
t AS (SELECT p.user_id, x, y, max(event_id) AS version FROM p JOIN w ON p.user_id = w.user_id AND off <= x AND stop >= y GROUP BY ALL),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY x) AS part FROM (SELECT *, CASE WHEN lag(version) OVER o = version AND lag(y) OVER o = x THEN 0 ELSE 1 END AS f FROM t WINDOW o AS (PARTITION BY user_id ORDER BY x)))
SELECT user_id, version, min(x) AS off, max(y) AS stop FROM n GROUP BY user_id, part, version""")
def interval_overlay(spark, d):
    w = _claims(spark, d).where("stop > off").select("user_id", "off", "stop", F.col("event_id").alias("version"))
    return intervals.overlay(w, ["user_id"])


# --- versions -----------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, d):
    return versions.latest(_t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
 l.c_custkey IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 AS superseded, l.c_custkey IS NULL AS deleted
FROM orders LEFT JOIN l ON o_custkey = c_custkey""")
def superseded_deleted(spark, d):
    live = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = versions.states(_t(spark, d, "orders"), live, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "version", "superseded", "deleted")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS versions, greatest(count(*) OVER (PARTITION BY l_partkey) - 8, 0) AS dropped FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) <= 8""")
def version_cap(spark, d):
    l = _t(spark, d, "lineitem")  # noqa: E741
    kept = versions.cap(l, ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 8)
    return kept.join(versions.cap_counts(l, ["l_partkey"], 8), "l_partkey").select("l_partkey", "l_orderkey", "l_linenumber", "versions", "dropped")


@query("""WITH q AS (SELECT c_custkey, t FROM customer, (VALUES (TIMESTAMP '1993-06-30'), (TIMESTAMP '1995-06-30'), (TIMESTAMP '1997-06-30')) v(t))
SELECT c_custkey AS o_custkey, t AS cutoff, (SELECT max(struct_pack(d := o_orderdate, k := o_orderkey)).k FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= t) AS o_orderkey FROM q""")
def asof_state(spark, d):
    cutoffs = F.array(*(F.lit(x).cast("timestamp_ntz") for x in ("1993-06-30", "1995-06-30", "1997-06-30")))
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(cutoffs).alias("cutoff"))
    orders = _t(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    return versions.as_of(asked, orders, ["o_custkey"], "cutoff", ["o_orderdate", "k"], "o_orderkey")


@query("""WITH f AS (SELECT event_id, user_id, CASE WHEN lag(event_type) OVER o = event_type AND epoch(ts) - epoch(lag(ts) OVER o) <= 86400 THEN 0 ELSE 1 END AS f, ts FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS "group" FROM f""")
def write_sessions(spark, d):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    same = (F.lag("event_type").over(order) == F.col("event_type")) & (seconds(F.col("ts")) - seconds(F.lag("ts").over(order)) <= 86400)
    return versions.write_groups(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], same).select("event_id", "user_id", "group")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, (o_orderkey % 7)::BIGINT AS raw, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderdate FROM orders)
SELECT o_custkey, o_orderkey, raw, n + greatest(0, max(raw - n) OVER (PARTITION BY o_custkey ORDER BY n)) AS version FROM r""")
def path_versions(spark, d):
    o = _t(spark, d, "orders").withColumn("raw", F.col("o_orderkey") % 7)
    return versions.running_versions(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "raw").select("o_custkey", "o_orderkey", "raw", "version")


# --- comparison ---------------------------------------------------------------------------------


def _side(spark, d, sources: list[str]) -> DataFrame:
    docs = _t(spark, d, "documents").where(F.col("source").isin(sources))
    return diff.flatten(docs.select(F.concat_ws("/", "lang", (F.col("doc_id") % 97).cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "source", F.col("doc_id").alias("ord"), F.col("n_chars").alias("size"), F.col("source").alias("node")))


_A, _B = [f"src{k}" for k in range(0, 10)], [f"src{k}" for k in range(10, 20)]
_SIDE = """SELECT lang || '/' || (doc_id % 97) AS path, list_sort(list_distinct(list(sha256(text)))) AS c FROM documents WHERE source IN ({}) GROUP BY ALL"""
_SIDES = f"a AS ({_SIDE.format(', '.join(map(repr, _A)))}), b AS ({_SIDE.format(', '.join(map(repr, _B)))})"
_STATE = "CASE WHEN b.{0} IS NULL THEN 'removed' WHEN a.{0} IS NULL THEN 'added' WHEN a.{1} = b.{1} THEN 'same' ELSE 'changed' END"


@query(f"""WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, {_STATE.format("path", "c")} AS state, a.c[1] AS sha_a, b.c[1] AS sha_b FROM a FULL JOIN b ON a.path = b.path""")
def file_diff(spark, d):
    return diff.files(_side(spark, d, _A), _side(spark, d, _B))


@query(f"""WITH {_SIDES}, x AS (SELECT DISTINCT unnest(c) AS s FROM a), y AS (SELECT DISTINCT unnest(c) AS s FROM b), m AS (SELECT s FROM x INTERSECT SELECT s FROM y),
k AS (SELECT DISTINCT unnest(list_intersect(a.c, b.c)) AS s FROM a JOIN b ON a.path = b.path)
SELECT (SELECT count(*) FROM x) AS distinct_a, (SELECT count(*) FROM y) AS distinct_b, (SELECT count(*) FROM m) AS common, (SELECT count(*) FROM m WHERE s NOT IN (SELECT s FROM k)) AS moved""")
def content_diff(spark, d):
    return diff.contents(_side(spark, d, _A), _side(spark, d, _B))


@query("""WITH a AS (SELECT 'nation.' || c_nationkey AS key, list_sort(list_distinct(list(c_mktsegment))) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
b AS (SELECT 'nation.' || c_nationkey AS key, list_sort(list_distinct(list(c_mktsegment))) AS v FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state,
array_to_string(a.v, ' | ') AS value_a, array_to_string(b.v, ' | ') AS value_b FROM a FULL JOIN b ON a.key = b.key""")
def fact_diff(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation."), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return diff.facts(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"))


_REC = """SELECT p_brand AS kind, p_type AS identity, 'p' || p_partkey AS path, p_size::VARCHAR AS size, p_name AS name FROM part WHERE p_partkey % 2 = {}
QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1"""


@query(f"""WITH a AS ({_REC.format(0)}), b AS ({_REC.format(1)})
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.identity, b.identity) AS identity,
CASE WHEN b.kind IS NULL THEN 'removed' WHEN a.kind IS NULL THEN 'added' WHEN a.name <> b.name OR a.size <> b.size THEN 'changed' WHEN a.path <> b.path THEN 'moved' ELSE 'same' END AS state,
CASE WHEN a.kind IS NULL OR b.kind IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.size <> b.size THEN 'size' END) END AS changed
FROM a FULL JOIN b ON a.kind = b.kind AND a.identity = b.identity""")
def record_diff(spark, d):
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"))
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("kind"), F.col("p_type").alias("identity"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("ord"), fields.alias("fields"))
    return diff.records(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"))


_WORDS = "SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS name FROM {}"


@query(f"""WITH a AS ({_WORDS.format("benchmark")}), b AS ({_WORDS.format("documents")})
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'common' END AS state FROM (FROM a WHERE name <> '') a FULL JOIN (FROM b WHERE name <> '') b ON a.name = b.name""")
def symbol_diff(spark, d):
    words = lambda t: _t(spark, d, t).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("name"))
    return diff.symbols(words("benchmark"), words("documents"))


@query(f"""WITH {_SIDES}, s AS (SELECT coalesce(a.path, b.path) AS path, {_STATE.format("path", "c")} AS state FROM a FULL JOIN b ON a.path = b.path)
SELECT path, state, count(*) OVER (PARTITION BY state) AS total FROM s QUALIFY row_number() OVER (PARTITION BY state ORDER BY path) <= 5""")
def capped_totals(spark, d):
    return diff.shown_rows(diff.files(_side(spark, d, _A), _side(spark, d, _B)).select("path", "state"), "path", 5)


@query("""WITH b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM benchmark)),
w AS (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, 1 AS f FROM documents)
SELECT item_id, count(*) AS expected, count(f) AS recovered, round(count(f) / count(*), 6) AS share FROM b LEFT JOIN w USING (w) GROUP BY item_id""")
def content_recovery(spark, d):
    words = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")
    return diff.recovery(_t(spark, d, "benchmark").select("item_id", words), _t(spark, d, "documents").select(words), ["item_id"], "w")


# --- survey, records, summaries -----------------------------------------------------------------

_MARKERS = [("en", 1, "the", 2), ("en", 1, "and", 1), ("de", 1, "der", 2), ("de", 1, "die", 1), ("fr", 1, "la", 2), ("fr", 1, "les", 1), ("es", 1, "el", 2), ("es", 1, "los", 1)]


@query(f"""WITH m(platform, "rank", w, weight) AS (VALUES {', '.join(map(str, _MARKERS))}),
x AS (SELECT DISTINCT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents),
s AS (SELECT doc_id, platform, "rank", sum(weight)::BIGINT AS score FROM x JOIN m USING (w) GROUP BY ALL)
SELECT doc_id, platform, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "rank" DESC, score DESC, list_position(['en', 'de', 'fr', 'es'], platform)) = 1""")
def marker_score(spark, d):
    markers = F.broadcast(spark.createDataFrame(_MARKERS, "platform string, rank int, w string, weight int"))
    words = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))).alias("w"))
    scored = words.join(markers, "w").groupBy("doc_id", "platform", "rank").agg(F.sum("weight").alias("score"))
    return survey.best(scored, ["doc_id"], ["en", "de", "fr", "es"]).select("doc_id", "platform", "score")


@query("""SELECT conv_id AS node, role AS key, count(DISTINCT text) AS n_values FROM conversations WHERE coalesce(text, '') <> '' GROUP BY ALL HAVING count(DISTINCT text) > 1""")
def fact_conflicts(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("node"), F.col("turn").alias("ord"), F.col("role").alias("key"), F.col("text").alias("value"))
    return survey.disagreements(c)


@query("""WITH q AS (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages), i AS (SELECT page_id, unnest(string_split(q, '&')) AS x, unnest(range(len(string_split(q, '&')))) AS pos FROM q),
k AS (SELECT page_id, split_part(x, '=', 1) AS key, substr(x, strpos(x, '=') + 1) AS value, pos FROM i WHERE strpos(x, '=') > 1)
SELECT page_id, key, arg_min(value, pos) AS value FROM k WHERE value <> '' GROUP BY ALL""")
def env_parse(spark, d):
    q = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "[?]([^#]*)", 1).alias("q"))
    return survey.env_pairs(q, ["page_id"], "q", "&")


@query("""SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events""")
def json_top_level(spark, d):
    return survey.json_facts(_t(spark, d, "events"), ["event_id"], "props")


@query("""WITH v AS (SELECT l_partkey, 'quantity' AS field, l_quantity::BIGINT::VARCHAR AS v, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_partkey, 'flag', l_returnflag, l_orderkey, l_linenumber FROM lineitem)
SELECT l_partkey, field, CASE WHEN bool_and(regexp_matches(v, '^[0-9]+$')) THEN sum(TRY_CAST(v AS BIGINT))::VARCHAR ELSE arg_min(v, struct_pack(a := l_orderkey, b := l_linenumber)) END AS value FROM v GROUP BY ALL""")
def record_merge(spark, d):
    # lines alike in both keys come in the order of the table
    l = _t(spark, d, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index")  # noqa: E741
    fields = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    records = l.select("l_partkey", F.struct("l_orderkey", "l_linenumber", "file_path", "row_index").alias("ord"), fields.alias("fields"))
    return summaries.merge_records(records, ["l_partkey"], "ord").select("l_partkey", F.explode("fields").alias("field", "value"))


@query("""WITH e AS (SELECT event_id AS ord, event_type AS format, user_id, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' ELSE 'unsupported' END AS status, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'e' || event_id END AS detail FROM events),
n AS (SELECT *, last_value(CASE WHEN status <> 'supported' THEN status END IGNORE NULLS) OVER (PARTITION BY format, user_id ORDER BY ord) AS hard FROM e)
SELECT format || ':' || user_id AS format, min(ord) AS ord, CASE WHEN arg_max(status, ord) = 'supported' AND coalesce(arg_max(CASE WHEN status = 'supported' THEN NULL ELSE status END, ord), '') = 'partial' THEN 'partial' ELSE arg_max(status, ord) END AS status,
coalesce(arg_max(CASE WHEN detail <> '' THEN detail END, ord), '') AS detail FROM n GROUP BY n.format, user_id""")
def coverage_fold(spark, d):
    n = F.col("event_id")
    status = F.when(n % 3 == 0, "supported").when(n % 3 == 1, "partial").otherwise("unsupported")
    e = _t(spark, d, "events").select(n.alias("ord"), F.concat_ws(":", "event_type", "user_id").alias("format"), status.alias("status"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("e"), n.cast("string"))).alias("detail"))
    return summaries.fold_coverage(e)


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer),
w AS (SELECT id, parent_id, ord, 0 AS depth, format('{:012d}', ord) AS key FROM n WHERE parent_id IS NULL
 UNION ALL SELECT n.id, n.parent_id, n.ord, w.depth + 1, w.key || '/' || format('{:012d}', n.ord) FROM n JOIN w ON n.parent_id = w.id)
SELECT id, parent_id, ord, depth, key FROM w""")
def tree_walk(spark, d):
    def rows(table, prefix, key, parent_prefix=None, parent=None):
        up = F.concat(F.lit(parent_prefix), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return _t(spark, d, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), up.alias("parent_id"), F.col(key).cast("long").alias("ord"))

    nodes = rows("region", "r", "r_regionkey").union(rows("nation", "n", "n_nationkey", "r", "n_regionkey")).union(rows("customer", "c", "c_custkey", "n", "c_nationkey"))
    return summaries.tree_walk(nodes)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def severity_counts(spark, d):
    return summaries.counts(_t(spark, d, "events"), "event_type")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
def kind_counts(spark, d):
    return summaries.counts_wide(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query("""SELECT CASE WHEN event_id % 3 = 1 THEN 'warning' ELSE 'error' END AS severity, event_type AS code, count(*) AS n, arg_min(user_id, event_id) AS first_owner, arg_min(props, event_id) AS message FROM events WHERE event_id % 3 > 0 GROUP BY ALL""")
def diag_tally(spark, d):
    n = F.col("event_id")
    e = _t(spark, d, "events").select(F.when(n % 3 == 0, "info").when(n % 3 == 1, "warning").otherwise("error").alias("severity"), F.col("event_type").alias("code"), F.col("user_id").alias("owner"), n.alias("ord"), F.col("props").alias("message"))
    return summaries.tally(e)
