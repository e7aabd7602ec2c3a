"""Catalogue, ledger, listing and planning queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as K
from ..operators import planning as P
from ..operators.blocks import Axis, number_rows
from ..operators.lineage import cut, shared_folder
from ..sources import landing as L
from ..sources.files import read_catalog
from ..sources.sinks import write_catalog
from .registry import long, query, r6
from .sqlbase import CATALOG, LEDGER, RECORDS, with_

TRANSFER = "CASE kind WHEN 'range_member' THEN coalesce(nullif(stored_size, 0), size, 0) + 512 WHEN 'range_package' THEN stored_size ELSE coalesce(size, 0) END"
SCRATCH = "CASE kind WHEN 'range_package' THEN coalesce(nullif(inflated_size, 0), 4*stored_size) WHEN 'file_images_embedded' THEN 2*coalesce(size, 0) ELSE coalesce(size, 0) END"
IMAGE = "(regexp_matches(path, '(^|/)(videos|images)/') OR regexp_matches(path, '(?i)\\.(mp4|avi|mkv|webm|mov|m4v|png|jpg|jpeg|bmp|gif|tif|tiff|exr|webp|heic)$'))"


@query("pj10_transfer_and_scratch", "PJ10", sql=with_(CATALOG, f"SELECT id, {TRANSFER} AS transfer, {SCRATCH} AS scratch FROM catalog"))
def _(spark, d):
    return L.catalog(spark, d).select("id", K.transfer_bytes().alias("transfer"), K.scratch_bytes().alias("scratch"))


@query("pj04_pj05_refusals", "PJ4", "PJ5", sql=with_(CATALOG, f"""
SELECT id, CASE WHEN kind = 'file_images_embedded' THEN 'embeds images' WHEN kind IN ('file', 'range_member') AND {IMAGE} AND NOT (coalesce(content = 'assets', false)
  AND regexp_matches(path, '(?i)\\.png$') AND NOT regexp_matches(path, '(^|/)videos/')) THEN 'image or video file' END AS refused FROM catalog"""))
def _(spark, d):
    return L.catalog(spark, d).select("id", K.refusal(F.col("kind"), F.col("content"), F.col("path"), strip=False).alias("refused"))


@query("pj04_image_urls", "PJ4", "PJ8", sql=f"""SELECT page_id, {IMAGE.replace("path", "url")} AS image, CASE WHEN regexp_matches(url, '/(\\d+)') THEN regexp_extract(url, '/(\\d+)', 1) END AS number FROM pages""")
def _(spark, d):
    n = F.regexp_extract("url", r"/(\d+)", 1)
    return L.table(spark, d, "pages").select("page_id", K.is_image_name(F.col("url")).alias("image"), F.when(n != "", n).alias("number"))


@query("pj06_pj07_dataset_names", "PJ6", "PJ7", sql="""
WITH n AS (SELECT p_partkey, '/data/demo_' || p_size || '/obs/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '_image' ELSE '' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'uint8' ELSE 'float64' END AS dtype, p_partkey % 5 AS ndim FROM part)
SELECT p_partkey, regexp_replace(name, '/demo_[0-9]+/', '/*/') AS pattern, regexp_matches(name, '(?i)image|img|rgb|video|depth|camera|pixels') OR (dtype = 'uint8' AND ndim >= 3) AS image FROM n""")
def _(spark, d):
    p = L.table(spark, d, "part")
    name = F.concat(F.lit("/data/demo_"), F.col("p_size").cast("string"), F.lit("/obs/"), F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_size") % 3 == 0, "_image").otherwise(""))
    dtype = F.when(F.col("p_partkey") % 4 == 0, "uint8").otherwise("float64")
    return p.select("p_partkey", K.demo_pattern(name).alias("pattern"), K.image_dataset(name, dtype, F.col("p_partkey") % 5).alias("image"))


@query("pj26_catalogue_listing", "PJ26", sql=with_(CATALOG, """
SELECT key, concat_ws(chr(9), id, CASE WHEN size IS NULL THEN '?' ELSE printf('%.1f MB', size/1e6) END, kind, coalesce(content, ''), license, CASE WHEN NOT usable THEN 'unusable' END) AS line FROM catalog"""))
def _(spark, d):
    return L.catalog(spark, d).select("key", *K.listing_line())


@query("pj01_jn01_entry_assembly", "PJ1", "PJ2", "JN1", "SC1", sql="""
WITH r AS (SELECT p_partkey AS key, p_brand AS grp, 'g/' || p_partkey AS src, CASE WHEN p_partkey % 3 = 0 THEN 'own/' || p_partkey END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'http://x/' || p_partkey END AS url,
  CASE WHEN p_partkey % 4 = 0 THEN 'a.tar' END AS archive, CASE WHEN p_partkey % 8 = 0 THEN 'd' END AS archive_sha256, CASE WHEN p_partkey % 11 = 0 THEN 'odd' END AS kind, CASE WHEN p_partkey % 6 = 0 THEN 'yes' WHEN p_partkey % 6 = 1 THEN 'no' ELSE '' END AS usable FROM part),
g AS (SELECT DISTINCT p_brand AS grp, lower(replace(p_brand, '#', '')) AS family, 'http://base/' AS url_base, 'pre/' AS path_prefix, CASE WHEN length(p_brand) = 7 THEN 'http://arch/' END AS archive_url, 'file' AS kind, 'mit' AS license FROM part),
e AS (SELECT key, family, coalesce(r.path, path_prefix || src) AS path, coalesce(url, CASE WHEN archive IS NOT NULL THEN coalesce(archive_url, CASE WHEN archive_sha256 IS NOT NULL THEN url_base || archive END) END, url_base || src) AS url,
  coalesce(r.kind, g.kind) AS kind, CASE WHEN usable = '' THEN true ELSE usable = 'yes' END AS usable, CASE WHEN archive IS NOT NULL AND coalesce(archive_url, CASE WHEN archive_sha256 IS NOT NULL THEN url_base || archive END) IS NULL THEN 'unknown archive' WHEN r.kind = 'odd' THEN 'unknown kind' END AS fault FROM r JOIN g USING (grp))
SELECT family || '/' || path AS id, url, kind, usable, fault FROM e""")
def _(spark, d):
    p, k = L.table(spark, d, "part"), F.col("p_partkey")
    cell = F.when(k % 6 == 0, "yes").when(k % 6 == 1, "no").otherwise("")
    rows = p.select(F.col("p_brand").alias("group"), F.lit(None).cast("string").alias("family"), F.concat(F.lit("g/"), k.cast("string")).alias("src"),
                    F.when(k % 3 == 0, F.concat(F.lit("own/"), k.cast("string"))).alias("path"), F.when(k % 5 == 0, F.concat(F.lit("http://x/"), k.cast("string"))).alias("url"),
                    F.when(k % 4 == 0, "a.tar").alias("archive"), F.when(k % 8 == 0, "d").alias("archive_sha256"), F.when(k % 11 == 0, "odd").alias("kind"),
                    F.lit(None).cast("string").alias("license"), F.when(cell != "", F.lower(cell).isin("1", "true", "yes")).alias("usable"))
    groups = p.select(F.col("p_brand").alias("group")).distinct().select(
        "group", F.lower(F.regexp_replace("group", "#", "")).alias("family"), F.lit("http://base/").alias("url_base"), F.lit("pre/").alias("path_prefix"),
        F.when(F.length("group") == 7, "http://arch/").alias("archive_url"), F.lit("file").alias("kind"), F.lit("mit").alias("license"), F.lit(None).cast("boolean").alias("usable"))
    return K.entries(rows, groups).select("id", "url", "kind", "usable", "fault")


@query("pj03_entry_selection", "PJ3", "SO3", sql=with_(CATALOG, """
pat AS (SELECT id AS pattern, key AS position FROM catalog WHERE license = 'license-1' UNION ALL SELECT family || '/' || split_part(path, '/', 1) || '/', 100000 + min(key) FROM catalog WHERE content = 'low_dim' GROUP BY 1),
h AS (SELECT c.id, p.position FROM catalog c JOIN pat p ON c.id = p.pattern UNION ALL SELECT c.id, p.position FROM catalog c JOIN pat p ON p.pattern LIKE '%/' AND starts_with(c.id, p.pattern) AND c.usable
  UNION ALL SELECT id, 1099511627776 FROM catalog WHERE usable AND family IN ('brand1', 'brand2') AND contains(id, 'red'))
SELECT id, min(position) AS position FROM h GROUP BY id"""))
def _(spark, d):
    c = L.catalog(spark, d).select("key", "id", "family", "path", "usable", "content", "license")
    exact = c.where(F.col("license") == "license-1").select(F.col("id").alias("pattern"), F.col("key").alias("position"))
    folder = F.concat("family", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"))
    below = c.where(F.col("content") == "low_dim").groupBy(folder.alias("pattern")).agg((F.min("key") + 100000).alias("position"))
    return K.select_entries(c.select("id", "family", "usable"), exact.unionByName(below), ["brand1", "brand2"], "red")


@query("jn04_ledger_verification", "JN4", "SC4", sql=with_(LEDGER, """
p AS (SELECT l.id, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.sha256 <> l.sha256_verified THEN 'sha256 mismatch' WHEN c.sha256 <> l.sha256_verified THEN 'ledger differs from catalog' END AS problem
  FROM ledger l LEFT JOIN listing f ON f.path = l.local_path LEFT JOIN catalog c ON c.id = l.id) SELECT id, problem FROM p WHERE problem IS NOT NULL"""))
def _(spark, d):
    return K.verify(L.ledger(spark, d), L.listing(spark, d), L.catalog(spark, d))


MEMBERS = "members AS (SELECT c.id, l.id AS member_id FROM catalog c JOIN catalog l ON l.key BETWEEN c.key + 1 AND c.key + 2 WHERE c.kind = 'range_package')"


def members(catalog):
    near = F.explode(F.array(F.col("key") + 1, F.col("key") + 2)).alias("key")
    return catalog.where(F.col("kind") == "range_package").select("id", near).join(catalog.select("key", F.col("id").alias("member_id")), "key").select("id", "member_id")


@query("jn05_not_fetched", "JN5", "JN6", sql=with_(LEDGER, MEMBERS + """,
w AS (SELECT m.id, bool_and(l.id IS NOT NULL) AS whole FROM members m LEFT JOIN ledger l ON l.id = m.member_id GROUP BY m.id)
SELECT c.id FROM catalog c LEFT JOIN w USING (id) WHERE usable AND c.id NOT IN (SELECT id FROM ledger) AND NOT (kind = 'range_package' AND coalesce(whole, false))"""))
def _(spark, d):
    c = L.catalog(spark, d).select("key", "id", "kind", "usable")
    return K.not_fetched(c, L.ledger(spark, d), members(c))


@query("jn02_jn03_identified_files", "JN2", "JN3", sql=with_(LEDGER, """
pin AS (SELECT sha256, min(id) AS by_content FROM catalog WHERE sha256 IS NOT NULL GROUP BY sha256),
o AS (SELECT f.path, p.by_content, c.id AS place, c.id IS NOT NULL AND l.sha256_verified = f.sha256 AND (c.sha256 IS NULL OR c.sha256 = f.sha256) AS agreed FROM listing f LEFT JOIN pin p USING (sha256) LEFT JOIN ledger l ON l.local_path = f.path LEFT JOIN catalog c ON c.id = substr(f.path, 5))
SELECT path, coalesce(by_content, CASE WHEN agreed THEN place END) AS entry, CASE WHEN by_content IS NOT NULL THEN 'content' WHEN agreed THEN 'place' END AS how FROM o"""))
def _(spark, d):
    return K.identify(L.listing(spark, d), L.catalog(spark, d), L.ledger(spark, d))


@query("so02_so04_root_merge", "SO4", "SO2", "SK10", sql=with_(LEDGER, """
u AS (SELECT id, sha256_verified AS sha FROM ledger UNION ALL SELECT id, sha256 FROM catalog WHERE sha256 IS NOT NULL AND key % 3 = 0),
g AS (SELECT id, min(sha) = max(sha) AS same, count(*) AS copies FROM u GROUP BY id) SELECT id, same, copies FROM g"""))
def _(spark, d):
    a = L.ledger(spark, d).select("id", F.col("sha256_verified").alias("sha"))
    b = L.catalog(spark, d).where(F.col("sha256").isNotNull() & (F.col("key") % 3 == 0)).select("id", F.col("sha256").alias("sha"))
    good, bad = K.merge_roots([a, b], "id", "sha")
    return good.select("id", F.lit(True).alias("same"), "copies").unionByName(bad.select("id", F.lit(False).alias("same"), "copies"))


@query("gt09_digest_checks", "GT9", "SC13", sql="""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars = length(text) THEN 'size' END, CASE WHEN doc_id % 3 <> 0 THEN 'sha256' END, CASE WHEN doc_id % 5 = 0 THEN 'git_blob_sha1' END], lambda v: v IS NOT NULL), ',') AS checks, sha1(text) AS sha1 FROM documents""")
def _(spark, d):
    t = F.col("text")
    raw = t.cast("binary")
    blob = F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(t).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))
    sha = F.sha2(raw, 256)
    checks = K.passed_checks(size=(F.col("n_chars"), F.length(t)), sha256=(F.when(F.col("doc_id") % 3 != 0, sha), sha), git_blob_sha1=(F.when(F.col("doc_id") % 5 == 0, blob), blob))
    return L.table(spark, d, "documents").select("doc_id", F.array_join(checks, ",").alias("checks"), F.sha1(raw).alias("sha1"))


@query("sc07_file_listing", "SC7", sql=with_(CATALOG, """
l AS (SELECT key AS line, CASE key % 4 WHEN 0 THEN key || ' /data/raw/f' || (key % 700) WHEN 1 THEN key || ' ./raw/f' || (key % 700) WHEN 2 THEN 'f' || (key % 700) ELSE CASE WHEN key % 8 = 3 THEN key || ' /other/f' || key ELSE '  ' END END AS value FROM catalog),
p AS (SELECT line, CASE WHEN line % 4 = 2 THEN 0 ELSE line END AS size, CASE WHEN line % 4 < 3 THEN 'raw/f' || (line % 700) END AS path FROM l WHERE trim(value) <> '')
SELECT path, arg_max(size, line) AS size, count(*) AS lines FROM p GROUP BY path"""))
def _(spark, d):
    k = F.col("key")
    s, m = k.cast("string"), (k % 700).cast("string")
    value = (F.when(k % 4 == 0, F.concat(s, F.lit(" /data/raw/f"), m)).when(k % 4 == 1, F.concat(s, F.lit(" ./raw/f"), m)).when(k % 4 == 2, F.concat(F.lit("f"), m))
             .when(k % 8 == 3, F.concat(s, F.lit(" /other/f"), s)).otherwise("  "))
    return K.parse_listing(L.catalog(spark, d).select(k.alias("line"), value.alias("value")), "/data")


@query("ag14_job_summary", "AG14", "SK8", sql=with_(CATALOG, f"""
t AS (SELECT family, {TRANSFER} AS t FROM catalog WHERE usable)
SELECT family, count(*) AS jobs, round(sum(t)/1e9, 2) AS total_gb, round(min(t)/1e9, 3) AS min_gb, round(list_sort(list(t))[len(list(t))//2 + 1]/1e9, 3) AS median_gb, round(max(t)/1e9, 3) AS max_gb FROM t GROUP BY family"""))
def _(spark, d):
    t = L.catalog(spark, d).where("usable").select("family", K.transfer_bytes().alias("t"))
    mid = P.upper_median(t, ["family"], "t", "median", span=1e7)
    g = t.groupBy("family").agg(F.count(F.lit(1)).alias("jobs"), r6(F.sum("t") / 1e9, 2).alias("total_gb"), r6(F.min("t") / 1e9, 3).alias("min_gb"), r6(F.max("t") / 1e9, 3).alias("max_gb"))
    return g.join(mid, "family").select("family", "jobs", "total_gb", "min_gb", r6(F.col("median") / 1e9, 3).alias("median_gb"), "max_gb")


@query("ag15_absent_by_folder", "AG15", "TK1", sql=with_(LEDGER, """
a AS (SELECT regexp_replace(id, '[^/]*$', '') AS folder FROM catalog WHERE usable AND id NOT IN (SELECT id FROM ledger)) SELECT folder, count(*) AS absent FROM a GROUP BY folder ORDER BY folder LIMIT 30"""))
def _(spark, d):
    gone = L.catalog(spark, d).where("usable").join(L.ledger(spark, d).select("id"), "id", "left_anti")
    return gone.groupBy(F.regexp_replace("id", "[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("absent")).orderBy("folder").limit(30)


COVER = f"""ch AS (SELECT id, family, {TRANSFER} AS transfer, {SCRATCH} AS scratch, usable FROM catalog WHERE usable AND key % 10 <> 7),
seg AS (SELECT id, transfer, unnest(range(1, len(string_split(id, '/')))) AS i FROM ch), fo AS (SELECT id, transfer, array_to_string(string_split(id, '/')[1:i], '/') || '/' AS folder FROM seg),
us AS (SELECT array_to_string(string_split(id, '/')[1:i], '/') || '/' AS folder, count(*) AS u FROM (SELECT id, unnest(range(1, len(string_split(id, '/')))) AS i FROM catalog WHERE usable) GROUP BY 1),
ins AS (SELECT folder, count(*) AS n, sum(transfer) AS b FROM fo GROUP BY folder), wh AS (SELECT folder FROM ins JOIN us USING (folder) WHERE n = u AND n > 1 AND b <= 1500000000),
cov AS (SELECT ch.*, coalesce((SELECT arg_min(fo.folder, length(fo.folder)) FROM fo JOIN wh USING (folder) WHERE fo.id = ch.id), ch.id) AS selector FROM ch)"""


def covered(spark, d):
    c = L.catalog(spark, d)
    chosen = c.where(F.col("usable") & (F.col("key") % 10 != 7)).select("id", "family", "kind", K.transfer_bytes().alias("transfer"), K.scratch_bytes().alias("scratch"))
    return P.prefix_cover(c.select("id", "usable"), chosen, 1_500_000_000)


@query("so05_prefix_cover", "SO5", sql=with_(CATALOG, COVER + " SELECT id, selector FROM cov"))
def _(spark, d):
    return covered(spark, d).select("id", "selector")


LIM = P.Limits(most=900_000_000, target=600_000_000, scratch=1_500_000_000, count=5)
PACKED = COVER + """,
un AS (SELECT family, selector, CAST(sum(transfer) AS BIGINT) AS t, CAST(sum(scratch) AS BIGINT) AS s, count(*) AS entries, row_number() OVER (PARTITION BY family ORDER BY selector) - 1 AS row FROM cov GROUP BY family, selector),
pk AS (WITH RECURSIVE r AS (SELECT family, selector, t, s, entries, row, t AS ct, s AS cs, 1 AS n, 0 AS batch FROM un WHERE row = 0
  UNION ALL SELECT u.family, u.selector, u.t, u.s, u.entries, u.row, CASE WHEN r.ct + u.t > 900000000 OR r.ct >= 600000000 OR r.cs + u.s > 1500000000 OR r.n >= 5 THEN u.t ELSE r.ct + u.t END,
    CASE WHEN r.ct + u.t > 900000000 OR r.ct >= 600000000 OR r.cs + u.s > 1500000000 OR r.n >= 5 THEN u.s ELSE r.cs + u.s END,
    CASE WHEN r.ct + u.t > 900000000 OR r.ct >= 600000000 OR r.cs + u.s > 1500000000 OR r.n >= 5 THEN 1 ELSE r.n + 1 END,
    CASE WHEN r.ct + u.t > 900000000 OR r.ct >= 600000000 OR r.cs + u.s > 1500000000 OR r.n >= 5 THEN r.batch + 1 ELSE r.batch END FROM r JOIN un u ON u.family = r.family AND u.row = r.row + 1) SELECT * FROM r),
bt AS (SELECT family, batch, sum(t) AS t, sum(s) AS s, count(*) AS units, sum(entries) AS entries, list_sort(list(selector)) AS sel FROM pk GROUP BY family, batch),
la AS (SELECT family, max(batch) AS last FROM bt GROUP BY family),
tl AS (SELECT b.family, last, count(*) = 2 AND arg_max(t, batch) < 200000000 AND sum(t) <= 900000000 AND sum(s) <= 1500000000 AND sum(units) <= 5 AS j FROM bt b JOIN la USING (family) WHERE batch >= last - 1 GROUP BY b.family, last),
jb AS (SELECT b.*, CASE WHEN j AND batch = last THEN batch - 1 ELSE batch END AS job FROM bt b JOIN tl USING (family))"""


def packed(spark, d):
    units = covered(spark, d).groupBy("family", "selector").agg(F.sum("transfer").alias("t"), F.sum("scratch").alias("s"), F.count(F.lit(1)).alias("entries"))
    units = cut(number_rows(units, ["family"], ["selector"], F.rpad(F.split_part("selector", F.lit("/"), F.lit(2)), 4, "/")))
    return P.pack(units, Axis(("family",), "row", 65_536), LIM, size="t", scratch="s")


@query("wn28_greedy_packing", "WN28", sql=with_(CATALOG, PACKED + " SELECT family, selector, CAST(batch AS BIGINT) AS batch FROM pk"))
def _(spark, d):
    return packed(spark, d).select("family", "selector", "batch")


@query("pl01_fetch_plan", "PL1", "FN-S2", "FN-S3", "SK8", sql=with_(CATALOG, PACKED + """,
fin AS (SELECT family, job, sum(t) AS t, sum(s) AS s, sum(units) AS units, sum(entries) AS entries, list_sort(flatten(list(sel))) AS sel FROM jb GROUP BY family, job)
SELECT 'fetch-' || family || '-' || substr(trim(regexp_replace(lower(regexp_replace(sel[1], '^[^/]*/', '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) || '-' || substr(sha1(array_to_string(sel, chr(10))), 1, 8) AS id,
  CAST(entries AS BIGINT) AS entries, CAST(t AS BIGINT) AS transfer_bytes, CAST(s AS BIGINT) AS scratch_bytes FROM fin"""))
def _(spark, d):
    jobs = packed(spark, d).groupBy("family", "batch").agg(F.sum("t").alias("transfer"), F.sum("s").alias("scratch"), F.count(F.lit(1)).alias("units"),
                                                           F.sum("entries").alias("entries"), F.collect_list("selector").alias("sel"))
    jobs = P.merge_small_tail(cut(jobs), ["family"], 200_000_000, LIM)
    out = jobs.groupBy("family", "job").agg(F.sum("transfer").alias("transfer_bytes"), F.sum("scratch").alias("scratch_bytes"), F.sum("entries").alias("entries"),
                                            F.array_sort(F.flatten(F.collect_list("sel"))).alias("sel"))
    return out.select(X.fetch_job_id(F.col("family"), F.col("sel")).alias("id"), "entries", "transfer_bytes", "scratch_bytes")


@query("wn29_consecutive_batches", "WN29", sql="""
WITH f AS (SELECT o_orderstatus AS grp, o_orderkey AS file, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 40 ORDER BY o_orderkey) - 1 AS row, o_custkey % 40 AS sub FROM orders),
pk AS (WITH RECURSIVE r AS (SELECT grp, sub, file, size, row, size AS used, 0 AS batch FROM f WHERE row = 0
  UNION ALL SELECT f.grp, f.sub, f.file, f.size, f.row, CASE WHEN r.used + f.size > 1000000 THEN f.size ELSE r.used + f.size END, CASE WHEN r.used + f.size > 1000000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN f ON f.grp = r.grp AND f.sub = r.sub AND f.row = r.row + 1) SELECT * FROM r)
SELECT file, CAST(batch AS BIGINT) AS batch FROM pk""")
def _(spark, d):
    f = L.table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), (F.col("o_custkey") % 40).alias("sub"), F.col("o_orderkey").alias("file"), F.floor("o_totalprice").alias("size"))
    f = cut(number_rows(f, ["grp", "sub"], ["file"], F.floor(F.col("file") / 65_536)))
    return P.pack(f, Axis(("grp", "sub"), "row", 65_536), P.Limits(most=1_000_000, count=4096), size="size").select("file", "batch")


UNITS = """u0 AS (SELECT regexp_extract(path, '^(raw/[^/]+/[^/]+)/', 1) AS unit, count(*) AS episodes FROM listing GROUP BY 1),
un AS (SELECT *, split_part(unit, '/', 2) AS family, split_part(unit, '/', 3) = 'economy' AS physics FROM u0 WHERE unit <> '')"""


def units(spark, d):
    unit = F.regexp_extract("path", r"^(raw/[^/]+/[^/]+)/", 1)
    u = L.listing(spark, d).groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("episodes")).where(F.col("unit") != "")
    return u.select("unit", "episodes", F.split_part("unit", F.lit("/"), F.lit(2)).alias("family"), (F.split_part("unit", F.lit("/"), F.lit(3)) == "economy").alias("physics"))


@query("pl02_input_units", "PL2", "UX4", sql=with_(LEDGER, UNITS + " SELECT unit, episodes, family, physics FROM un"))
def _(spark, d):
    return units(spark, d)


@query("pl04_build_shards", "PL4", "PJ13", sql=with_(LEDGER, UNITS + """,
b AS (SELECT *, CAST(ceil(episodes / 6.0::DOUBLE) AS BIGINT) AS n FROM un WHERE episodes > 8), k AS (SELECT *, unnest(range(0, n)) AS k FROM b)
SELECT unit, k, n, CAST(ceil((episodes - k) / n) AS BIGINT) AS shard_episodes FROM k""".replace("ceil((episodes - k) / n)", "ceil((episodes - k)::DOUBLE / n)")))
def _(spark, d):
    return P.shards(units(spark, d).where(F.col("episodes") > 8), 6).select("unit", "k", "n", "shard_episodes")


@query("pl04_build_packs", "PL4", "WN28", sql=with_(LEDGER, UNITS + """,
sm AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY unit) - 1 AS row FROM un WHERE episodes <= 8),
pk AS (WITH RECURSIVE r AS (SELECT family, unit, episodes, physics, row, episodes AS used, 0 AS batch FROM sm WHERE row = 0
  UNION ALL SELECT s.family, s.unit, s.episodes, s.physics, s.row, CASE WHEN r.used + s.episodes > 8 OR s.physics <> r.physics OR r.used >= 6 THEN s.episodes ELSE r.used + s.episodes END,
   CASE WHEN r.used + s.episodes > 8 OR s.physics <> r.physics OR r.used >= 6 THEN r.batch + 1 ELSE r.batch END FROM r JOIN sm s ON s.family = r.family AND s.row = r.row + 1) SELECT * FROM r)
SELECT family, CAST(batch AS BIGINT) AS batch, count(*) AS units, CAST(sum(episodes) AS BIGINT) AS episodes FROM pk GROUP BY ALL"""))
def _(spark, d):
    small = units(spark, d).where(F.col("episodes") <= 8)
    small = cut(number_rows(small, ["family"], ["unit"], F.substring(F.split_part("unit", F.lit("/"), F.lit(3)), 1, 2)))
    out = P.pack(small, Axis(("family",), "row", 65_536), P.Limits(most=8, target=6, count=8), size="episodes", segment="physics")
    return out.groupBy("family", "batch").agg(F.count(F.lit(1)).alias("units"), F.sum("episodes").alias("episodes"))


@query("pl03_trajectory_counts", "PL3", sql=with_(LEDGER, UNITS + """,
f AS (SELECT path, regexp_extract(path, '^(raw/[^/]+/[^/]+)/', 1) AS unit, regexp_replace(path, '^raw/', '') AS id FROM listing),
e AS (SELECT f.*, c.key, un.episodes AS listed FROM f JOIN catalog c USING (id) JOIN un USING (unit))
SELECT path, CASE WHEN key % 3 = 0 THEN key % 20 + 1 WHEN key % 3 = 1 THEN greatest(1, CAST(round(100.0::DOUBLE / listed) AS BIGINT)) ELSE 5 END AS trajectories, key % 3 = 0 AS exact FROM e"""))
def _(spark, d):
    f = L.listing(spark, d).select("path", F.regexp_extract("path", r"^(raw/[^/]+/[^/]+)/", 1).alias("unit"), F.regexp_replace("path", "^raw/", "").alias("id"))
    e = f.join(L.catalog(spark, d).select("id", "key"), "id").join(units(spark, d).select("unit", F.col("episodes").alias("listed")), "unit")
    counted = F.when(F.col("key") % 3 == 0, F.col("key") % 20 + 1)
    even = F.when(F.col("key") % 3 == 1, F.greatest(F.lit(1), F.round(100.0 / F.col("listed")).cast("long")))
    return e.select("path", F.coalesce(counted, even, F.lit(5)).alias("trajectories"), counted.isNotNull().alias("exact"))


@query("pl06_jn08_jn09_input_problems", "PL6", "JN8", "JN9", sql=with_(LEDGER, UNITS + """,
meta AS (SELECT DISTINCT family, split_part(path, '/', 1) AS task FROM catalog), data AS (SELECT DISTINCT split_part(path, '/', 2) AS family, split_part(path, '/', 3) AS task FROM listing)
SELECT 'raw/' || family || '/' || task || '/: no files (not fetched)' AS problem FROM meta WHERE NOT EXISTS (SELECT 1 FROM data x WHERE x.family = meta.family AND x.task = meta.task)
UNION ALL SELECT unit || '/meta.json: missing' FROM un WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = unit || '/meta.json')"""))
def _(spark, d):
    files = L.listing(spark, d).select("path")
    part = lambda c, i: F.split_part(c, F.lit("/"), F.lit(i))
    meta = L.catalog(spark, d).select("family", part("path", 1).alias("task")).distinct()
    data = files.select(part("path", 2).alias("family"), part("path", 3).alias("task")).distinct()
    gone = meta.join(data, ["family", "task"], "left_anti").select(F.concat(F.lit("raw/"), "family", F.lit("/"), "task", F.lit("/: no files (not fetched)")).alias("problem"))
    need = units(spark, d).select(F.concat("unit", F.lit("/meta.json")).alias("path")).join(files, "path", "left_anti")
    return gone.unionByName(need.select(F.concat("path", F.lit(": missing")).alias("problem")))


@query("jn10_package_tables_disagree", "JN10", "SC12", sql=with_(LEDGER, """
SELECT c.id FROM catalog c JOIN listing l ON l.path = 'raw/' || c.id WHERE c.size <> l.size OR c.sha256 <> l.sha256"""))
def _(spark, d):
    l = L.listing(spark, d).select(F.regexp_replace("path", "^raw/", "").alias("id"), F.col("size").alias("listed"), F.col("sha256").alias("found"))
    return L.catalog(spark, d).join(l, "id").where((F.col("size") != F.col("listed")) | (F.col("sha256") != F.col("found"))).select("id")


@query("jn26_member_digests", "JN26", sql=with_(LEDGER, """
SELECT c.id, CASE WHEN l.path IS NULL THEN 'member absent' WHEN c.sha256 IS NULL THEN 'no digest' WHEN c.sha256 = l.sha256 THEN 'verified' ELSE 'digest differs' END AS note FROM catalog c LEFT JOIN listing l ON l.path = 'raw/' || c.id"""))
def _(spark, d):
    l = L.listing(spark, d).select(F.regexp_replace("path", "^raw/", "").alias("id"), F.col("sha256").alias("found"))
    note = F.when(F.col("found").isNull(), "member absent").when(F.col("sha256").isNull(), "no digest").when(F.col("sha256") == F.col("found"), "verified").otherwise("digest differs")
    return L.catalog(spark, d).join(l, "id", "left").select("id", note.alias("note"))


@query("ag13_ratio_estimators", "AG13", sql="""
SELECT l_returnflag || l_linestatus AS config, round(sum(l_extendedprice)/sum(l_quantity), 4) AS bytes_per_trajectory, round(sum(l_extendedprice*l_discount)/sum(l_extendedprice), 6) AS share FROM lineitem GROUP BY 1""")
def _(spark, d):
    li = L.table(spark, d, "lineitem")
    p, q = F.sum("l_extendedprice"), F.sum("l_quantity")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("config")).agg(r6(p / q, 4).alias("bytes_per_trajectory"), r6(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / p).alias("share"))


@query("tk02_wn27_pl09_budgeted_selection", "WN27", "PL9", "TK2", sql=with_(CATALOG, """
c AS (SELECT *, sha1(family || '/' || path) AS h, key % 4 = 0 AS val FROM catalog WHERE usable),
r AS (SELECT id, family, val, p_size AS est, sum(p_size) OVER (PARTITION BY family, val ORDER BY h) - p_size AS before FROM c)
SELECT id, family, val FROM r WHERE before < CASE WHEN val THEN 40 ELSE 200 END"""))
def _(spark, d):
    c = L.catalog(spark, d).join(L.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("est")), "key")
    c = c.where("usable").select("id", "family", "path", (F.col("key") % 4 == 0).alias("val"), "est")
    out = P.budgeted(c, ["family", "val"], P.hash_order(F.col("family"), F.col("path")), "est", F.when(F.col("val"), F.lit(40)).otherwise(F.lit(200)))
    return out.select("id", "family", "val")


@query("tk04_stratified_counts", "TK4", sql="""
WITH c AS (SELECT d.lang AS cell, l.quality = 1 AS passed, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT cell, passed, least(n, CASE WHEN passed THEN 12 ELSE 7 END) AS drawn FROM c""")
def _(spark, d):
    rec = L.table(spark, d, "documents").select("doc_id", "lang").join(L.table(spark, d, "labels"), "doc_id").select(
        F.col("lang").alias("cell"), (F.col("quality") == 1).alias("passed"), "doc_id")
    return P.stratified(rec, "cell", "passed", "doc_id", 7, 12, 7).groupBy("cell", "passed").agg(F.count(F.lit(1)).alias("drawn"))


@query("tk05_pl05_one_per_scene", "TK5", "PL5", sql="""
WITH p AS (SELECT sha256(CAST(n_chars % 97 AS VARCHAR)) AS scene, source AS raw, doc_id AS file FROM documents), o AS (SELECT scene, arg_min(raw, file) AS raw, min(file) AS file FROM p GROUP BY scene)
SELECT raw, count(*) AS scenes, array_to_string(list_sort(list(file)), ',') AS files FROM o GROUP BY raw""")
def _(spark, d):
    docs = L.table(spark, d, "documents").select(F.sha2((F.col("n_chars") % 97).cast("string").cast("binary"), 256).alias("scene"), F.col("source").alias("raw"), F.col("doc_id").alias("file"))
    one = P.one_per_key(docs.withColumn("at", F.col("file")), "scene", "at")
    # scenes are distinct here: the list holds one short id per distinct scene of a raw file
    return one.groupBy("raw").agg(F.count(F.lit(1)).alias("scenes"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@query("pl07_running_jobs", "PL7", sql="""
WITH e AS (SELECT 'w' || user_id AS id, CASE event_type WHEN 'click' THEN 'launched' WHEN 'purchase' THEN 'launched' WHEN 'view' THEN 'requeued' ELSE 'finished' END AS event, epoch_us(ts) AS t, event_id FROM events),
l AS (SELECT id, arg_max(event, t) AS event, max(t) AS t FROM e GROUP BY id) SELECT id, t FROM l WHERE event = 'launched'""")
def _(spark, d):
    e = L.table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "launched").when(F.col("event_type") == "view", "requeued").otherwise("finished")
    return K.running_jobs(e.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("id"), kind.alias("event"), L.micros("ts").alias("t")))


@query("pl08_incomplete_transfers", "PL8", "SO2", sql=with_(LEDGER, """SELECT path FROM listing WHERE path NOT IN (SELECT local_path FROM ledger WHERE n % 3 = 0)"""))
def _(spark, d):
    done = L.ledger(spark, d).where(F.col("n") % 3 == 0).select(F.col("local_path").alias("path"))
    return L.listing(spark, d).select("path").join(done, "path", "left_anti")


@query("sk09_checksum_lines", "SK9", sql=with_(LEDGER, "SELECT sha256 || '  ./' || path AS line FROM listing"))
def _(spark, d):
    return L.listing(spark, d).select(F.format_string("%s  ./%s", "sha256", "path").alias("line"))


@query("fn_s2_s5_identifiers", "FN-S2", "FN-S4", "FN-S5", "PJ15", "PJ24", sql="""
SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug, replace(split_part(url, '://', 2), '/', '__') AS stem, 'pages/' || page_id || '-stage' || lpad(CAST(page_id % 40 AS VARCHAR), 2, '0') AS uri,
  'sha256:' || sha256('{"id":"' || page_id || '","lang":"x"}') AS digest FROM pages""")
def _(spark, d):
    p = L.table(spark, d, "pages")
    k = F.col("page_id").cast("string")
    uri = F.concat(F.lit("pages/"), k, F.lit("-stage"), F.lpad((F.col("page_id") % 40).cast("string"), 2, "0"))
    digest = X.map_digest(F.create_map(F.lit("lang"), F.lit("x"), F.lit("id"), k))
    return p.select("page_id", X.slug(F.col("url")).alias("slug"), F.replace(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit("__")).alias("stem"), uri.alias("uri"), digest.alias("digest"))


@query("pj13_pj14_shards_and_ranges", "PJ13", "PJ14", sql="""
WITH r AS (SELECT o_orderpriority AS file, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT file, o_orderkey FROM r WHERE pos % 7 = 3 AND (o_orderkey BETWEEN 0 AND 5000 OR o_orderkey BETWEEN 9000 AND 12000 OR o_orderkey = 13001)""")
def _(spark, d):
    o = L.table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), "o_orderkey")
    out = P.shard_rows(o, ["file"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 65_536), 3, 7)
    return out.where(P.in_ranges(F.col("o_orderkey"), "0-5000,9000-12000,13001"))


@query("sc02_sc03_family_scan", "SC2", "SC3", "PJ16", sql=with_(CATALOG, """
st AS (SELECT DISTINCT family, CASE WHEN try_cast(regexp_extract(family, '[0-9]+$') AS BIGINT) % 4 = 0 THEN 'excluded' ELSE 'available' END AS status FROM catalog) SELECT c.id, c.family FROM catalog c JOIN st USING (family) WHERE st.status = 'available' AND c.kind <> 'range_member'"""))
def _(spark, d):
    """Inline entries of available families, from a catalogue table partitioned by family and origin.

    Every family has a status, "available" unless its number says otherwise. Member rows are pruned when the plan is made,
    unavailable families when it runs: the status table filters the partitions that are opened."""
    path = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    entries = L.catalog(spark, d).select("id", "family", F.when(F.col("kind") == "range_member", "table").otherwise("inline").alias("origin"))
    write_catalog(entries, path)
    number = F.regexp_extract("family", "[0-9]+$", 0).try_cast("long")
    families = cut(L.catalog(spark, d).select("family").distinct().withColumn("status", F.when(number % 4 == 0, "excluded").otherwise("available")))
    open_ = families.where(F.col("status") == "available").select("family")
    return read_catalog(spark, path, tables=False).join(open_, "family", "left_semi").select("id", "family")


@query("jn28_file_packages", "JN28", sql=with_(LEDGER, MEMBERS + """,
md AS (SELECT c.sha256, min(m.id) AS by_digest FROM members m JOIN catalog c ON c.id = m.member_id WHERE c.sha256 IS NOT NULL GROUP BY 1), fo AS (SELECT 'raw/' || regexp_replace(id, '/[^/]*$', '') AS folder, min(id) AS by_folder FROM catalog WHERE kind = 'range_package' GROUP BY 1)
SELECT l.path, coalesce(by_digest, by_folder) AS package FROM listing l LEFT JOIN md USING (sha256) LEFT JOIN fo ON fo.folder = regexp_replace(l.path, '/[^/]*$', '')"""))
def _(spark, d):
    c = L.catalog(spark, d).select("key", "id", "kind", "sha256")
    packages = c.where(F.col("kind") == "range_package").select("id", F.concat(F.lit("raw/"), F.regexp_replace("id", "/[^/]*$", "")).alias("folder"))
    listed = members(c).join(c.select(F.col("id").alias("member_id"), "sha256"), "member_id").where(F.col("sha256").isNotNull()).select("id", "sha256")
    return K.package_of(L.listing(spark, d).select("path", "sha256"), packages, listed)


@query("pj25_export_status", "PJ25", sql=with_(RECORDS, """
a AS (SELECT l_orderkey AS uid, bool_and(l_returnflag <> 'R') AS inside FROM lineitem GROUP BY 1)
SELECT uid, CASE WHEN NOT p_known THEN 'no_physics' WHEN file IS NULL THEN 'no_source' WHEN NOT coalesce(inside, true) THEN 'unresolved_assets' ELSE 'candidate' END AS status FROM records LEFT JOIN a USING (uid)"""))
def _(spark, d):
    rec = L.records(spark, d).select("uid", F.col("P").isNotNull().alias("has_physics"), F.col("file").alias("source"))
    found = F.when(F.col("l_returnflag") == "R", "resolver").otherwise("assets:exact")
    return K.export_status(rec, L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), found.alias("found")))
