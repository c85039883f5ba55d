"""Queries of catalogue ETL, exports, searches and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import config as C
from tessella.functions import text as T
from tessella.operators import catalog as K
from tessella.registry import query
from tessella.sources import documents as D

from .views import SQL, buttons, records, table, with_, written

SQL["urls"] = "urls AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS path, url FROM pages)"
SQL["titles"] = "titles AS (SELECT doc_id, source, lang, trim(split_part(text, chr(10), 1)) AS title FROM documents)"
WORDS = ", ".join(f"'{w}'" for w in C.BUTTON_WORDS)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.split(F.get(F.split("url", r"\?"), F.lit(0)), "#"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "url")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.trim(F.get(F.split("text", "\n"), F.lit(0))).alias("title"))


@query(with_("buttons") + "SELECT rid, count(*) AS n_buttons, count(*) FILTER (WHERE color IN ('RF', 'AF')) AS n_chromatic, count(*) FILTER (WHERE pos % 3 = 0) AS n_labelled, 'photo' || rid || '_a' AS stem, CAST(rid % 3 AS INTEGER) AS crop FROM buttons GROUP BY rid")
def a1_flatten_documents(spark, sf):
    b = buttons(spark, sf)
    label = F.when(F.col("pos") % 3 == 0, F.col("label"))
    docs = b.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "color", label.alias("label")))).alias("buttons"))
    record_id = F.concat(F.lit("photo"), F.col("rid").cast("string"), F.lit("_a_"), (F.col("rid") % 3).cast("string"))
    return docs.select(
        "rid",
        F.size("buttons").cast("long").alias("n_buttons"),
        F.size(F.filter("buttons", lambda x: x.color.isin("RF", "AF"))).cast("long").alias("n_chromatic"),
        F.size(F.filter("buttons", lambda x: x.label.isNotNull())).cast("long").alias("n_labelled"),
        T.record_stem(record_id).alias("stem"),
        T.crop_index(record_id).alias("crop"),
    )


@query(with_("buttons", "records") + "SELECT code AS norm_code, count(*) AS n, min(rid) AS first_rid, max(rid) AS last_rid FROM records WHERE code IS NOT NULL AND rid % 11 <> 0 GROUP BY code")
def a2_code_map(spark, sf):
    live = table(spark, sf, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("rid"))
    codes = records(spark, sf).select("rid", T.norm_label(F.col("code")).alias("norm_code")).where("norm_code IS NOT NULL")
    return codes.join(live, "rid", "left_semi").groupBy("norm_code").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid"))


@query("SELECT doc_id, regexp_replace(trim(split_part(text, chr(10), 1)), '\\s+', ' ', 'g') AS title FROM documents WHERE length(trim(split_part(text, chr(10), 1))) > 0")
def a3_export_titles(spark, sf):
    return titles(spark, sf).where(F.length("title") > 0).select("doc_id", T.collapse_spaces(F.col("title")).alias("title"))


@query("SELECT count(*) AS rows, count(DISTINCT quality * 2 + toxic) AS groups FROM labels WHERE quality IS NOT NULL")
def a4_export_truth(spark, sf):
    return table(spark, sf, "labels").where("quality IS NOT NULL").agg(F.count("*").alias("rows"), F.countDistinct(F.col("quality") * 2 + F.col("toxic")).alias("groups"))


@query("""SELECT coalesce(o.k, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN o.bal ELSE n.bal END AS bal, coalesce(o.seg, n.seg) AS seg,
       CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'stale' ELSE 'updated' END AS action
       FROM (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0) o
       FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS bal, 'new' AS seg FROM customer WHERE c_custkey % 3 <> 0) n ON o.k = n.k""")
def a5_upsert_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 3 <> 0").withColumns({"bal": F.col("bal") + 1, "seg": F.lit("new")})
    return K.upsert(c.where("c_custkey % 2 = 0"), new, "c_custkey", kept=["seg"])


@query("""SELECT CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'stale' ELSE 'updated' END AS action, count(*) AS n
       FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) n ON o.k = n.k GROUP BY 1""")
def d40_import_counts(spark, sf):
    return a5_upsert_merge(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


REASON = "CASE WHEN n_chars < 50 THEN 'too short: ' || n_chars WHEN text LIKE '%***%' THEN 'symbols (many)' WHEN doc_id % 17 = 0 THEN 'no body' END"


@query(f"SELECT rtrim(split_part(split_part(reason, ':', 1), '(', 1)) AS reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1")
def a6_rejects(spark, sf):
    reason = F.when(F.col("n_chars") < 50, F.concat(F.lit("too short: "), F.col("n_chars").cast("string"))).when(F.col("text").contains("***"), "symbols (many)").when(F.col("doc_id") % 17 == 0, "no body")
    rejects = table(spark, sf, "documents").select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
    return rejects.groupBy(T.reason_prefix(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


@query(with_("urls") + "SELECT count(*) AS wanted, count(*) FILTER (WHERE page_id % 4 = 0) AS missing FROM urls WHERE length(path) > 0")
def a7_manifest_scan(spark, sf):
    line = F.concat(F.col("page_id").cast("string"), F.lit(" "), "path")
    manifest = D.read_manifest(spark, written(urls(spark, sf).select(F.when(F.length("path") > 0, line).otherwise("  ")), "manifest"))
    wanted = manifest.select(F.get(F.split("path", " "), F.lit(0)).cast("long").alias("page_id"))
    there = table(spark, sf, "pages").where("page_id % 4 <> 0").select("page_id").withColumn("there", F.lit(True))
    return wanted.join(there, "page_id", "left").agg(F.count("*").alias("wanted"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 9 <> 0""")
def a8_parse_snapshot(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return table(spark, sf, "events").select("event_id", parsed.alias("p")).where("p._corrupt IS NULL").select("event_id", "p.k")


@query("SELECT DISTINCT replace(p_brand, '#', '-') AS brand FROM part WHERE p_partkey % 7 <> 0")
def a9_brand_list(spark, sf):
    line = F.concat(F.when(F.col("p_partkey") % 7 == 0, "# ").otherwise(""), F.translate("p_brand", "#", "-"), F.lit("  # note"))
    return D.read_brands(spark, written(table(spark, sf, "part").select(line), "brands")).distinct()


@query("SELECT doc_id AS rid, CAST(quality AS VARCHAR) AS identity FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def a10_truth_parse(spark, sf):
    tab = F.lit("\t")
    row = F.concat(F.when(F.col("doc_id") % 5 == 0, "#").otherwise(""), F.col("doc_id").cast("string"), tab, F.col("quality").cast("string"), F.when(F.col("doc_id") % 7 == 0, "\textra").otherwise(""))
    truth = D.read_truth(spark, written(table(spark, sf, "labels").select(row), "truth"))
    return truth.select(F.col("record_id").cast("long").alias("rid"), "identity")


@query("SELECT d.doc_id, coalesce(l.reviewed, false) AS reviewed FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, toxic * 10 + quality) = 1 AS reviewed FROM labels GROUP BY doc_id) l USING (doc_id)")
def a14_review_update(spark, sf):
    last = table(spark, sf, "labels").groupBy("doc_id").agg((F.max_by("quality", F.col("toxic") * 10 + F.col("quality")) == 1).alias("r"))
    return table(spark, sf, "documents").select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("SELECT d.doc_id, d.lang, length(d.text) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.quality IS NULL OR l.quality = 0) AND (contains(lower(d.source), 'src1') OR contains(d.lang, 'de')) ORDER BY n, doc_id LIMIT 200")
def b8_catalog_search(spark, sf):
    met = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    hit = F.lower("source").contains("src1") | F.col("lang").contains("de")
    return met.where((F.col("quality").isNull() | (F.col("quality") == 0)) & hit).select("doc_id", "lang", F.length("text").cast("long").alias("n")).orderBy("n", "doc_id").limit(200)


@query(with_("buttons", "records") + "SELECT rid, round(quality, 6) AS quality FROM records WHERE rid % 2 = 1 AND quality < 0.75")
def b9_needs_review(spark, sf):
    return records(spark, sf).where((F.col("rid") % 2 == 1) & (F.col("quality") < C.REVIEW_QUALITY)).select("rid", F.round("quality", 6).alias("quality"))


@query(with_("buttons") + "SELECT rid, '{\"aspect\":' || (1 + rid % 6) || ',\"n_buttons\":' || count(*) || ',\"captions\":' || count(*) FILTER (WHERE pos % 4 = 0 AND pos % 8 <> 0) || '}' AS body FROM buttons GROUP BY rid")
def b15_document_assembly(spark, sf):
    role = F.when(F.col("pos") % 8 == 0, "label").otherwise("caption")
    region = F.when(F.col("pos") % 4 == 0, F.struct("pos", role.alias("role")))
    docs = buttons(spark, sf).groupBy("rid").agg(F.count("*").alias("n"), F.collect_list(region).alias("regions"))
    captions = F.size(F.filter("regions", lambda r: r.role != "label"))
    return docs.select("rid", F.to_json(F.struct((1 + F.col("rid") % 6).alias("aspect"), F.col("n").alias("n_buttons"), captions.alias("captions"))).alias("body"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN 'https://shop/item/' || o_custkey || '/view' END AS url FROM orders")
def b19_item_url(spark, sf):
    model = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey").cast("string"))
    url = F.when(model.isNotNull(), F.replace(F.lit("https://shop/item/{id}/view"), F.lit("{id}"), model))
    return table(spark, sf, "orders").select("o_orderkey", url.alias("url"))


@query("SELECT CAST(1 + c_custkey % 3 AS INTEGER) AS v, count(*) AS n FROM customer WHERE 1 + c_custkey % 3 <> 2 GROUP BY 1")
def b21_stale_version(spark, sf):
    v = table(spark, sf, "customer").select((1 + F.col("c_custkey") % 3).cast("int").alias("v"))
    return v.where(F.col("v") != C.FINGERPRINT_VERSION).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 500 = 0)")
def b24_point_lookup(spark, sf):
    asked = table(spark, sf, "orders").where("o_orderkey % 500 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").join(asked, "c_custkey", "left_semi")


@query(with_("buttons") + "SELECT (SELECT count(*) FROM customer) AS records, count(DISTINCT rid) AS docs, 2 AS version, CAST(NULL AS VARCHAR) AS error FROM buttons")
def b25_status_row(spark, sf):
    docs = buttons(spark, sf).agg(F.countDistinct("rid").alias("docs"))
    n = table(spark, sf, "customer").agg(F.count("*").alias("records"))
    return n.join(F.broadcast(docs)).select("records", "docs", F.lit(C.FINGERPRINT_VERSION).alias("version"), F.lit(None).cast("string").alias("error"))


@query("SELECT o_orderkey AS nid, p_name AS title, l_suppkey AS fid FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND o_orderstatus = 'F'")
def c1_legacy_three_way(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    nodes = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    met = lines.join(nodes, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return met.select(F.col("o_orderkey").alias("nid"), F.col("p_name").alias("title"), F.col("l_suppkey").alias("fid"))


STEM = r"regexp_replace(regexp_extract(rtrim(path, '/'), '[^/]*$'), '\.[^.]*$', '')"


@query(with_("urls", f"meta AS (SELECT {STEM} AS stem, min(page_id % 50) AS nid FROM urls GROUP BY 1 HAVING count(DISTINCT page_id % 50) = 1)") + "SELECT doc_id, nid FROM documents LEFT JOIN meta ON stem = CAST(doc_id AS VARCHAR)")
def c2_metadata_unambiguous(spark, sf):
    stems = urls(spark, sf).select(T.stem(F.regexp_replace("path", "/+$", "")).alias("stem"), (F.col("page_id") % 50).alias("nid"))
    meta = K.unambiguous(stems, "stem", "nid")
    return table(spark, sf, "documents").select("doc_id").join(meta, F.col("doc_id").cast("string") == F.col("stem"), "left").select("doc_id", "nid")


@query("SELECT doc_id, brand FROM (SELECT doc_id, upper(regexp_replace(unnest(string_split(text, ' ')), '[^A-Za-z0-9]+', '', 'g')) AS w FROM documents) JOIN (SELECT DISTINCT upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS k, p_name AS brand FROM part UNION SELECT 'THE', 'The') ON w = k WHERE length(w) >= 3 GROUP BY ALL")
def c15_brand_exact(spark, sf):
    bare = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("t")).select("doc_id", bare(F.col("t")).alias("w")).where(F.length("w") >= 3)
    known = table(spark, sf, "part").select(bare(F.col("p_name")).alias("w"), F.col("p_name").alias("brand")).distinct()
    known = known.unionByName(spark.range(1).select(F.lit("THE").alias("w"), F.lit("The").alias("brand")))
    return words.join(known, "w").select("doc_id", "brand").distinct()


@query("""WITH t AS (SELECT c_custkey AS rid, CASE c_custkey % 4 WHEN 0 THEN 'BN59-' || c_custkey || 'B оригинальный пульт для UE65' WHEN 1 THEN 'HDMI1, AA_' || c_custkey || '99; Пульт X' WHEN 2 THEN 'no code here' ELSE 'ab ' || c_custkey || ' пульт' END AS title,
          CASE WHEN c_custkey % 8 = 0 THEN 'BN59-' || c_custkey || 'B' WHEN c_custkey % 3 = 0 THEN 'OLD1' END AS ocr FROM customer),
       k AS (SELECT rid, ocr, CASE rid % 4 WHEN 0 THEN 'BN59-' || rid || 'B' WHEN 1 THEN 'AA-' || rid || '99' WHEN 3 THEN CASE WHEN length(CAST(rid AS VARCHAR)) >= 5 THEN CAST(rid AS VARCHAR) END END AS code FROM t WHERE rid % 10 <> 9)
       SELECT CASE WHEN k.rid IS NULL THEN 'absent' WHEN code IS NULL THEN 'no_code' WHEN k.ocr IS NULL THEN 'added' WHEN k.ocr = code THEN 'agreed' ELSE 'replaced' END AS status, count(*) AS n
       FROM t LEFT JOIN k USING (rid) GROUP BY 1""")
def c16_codes_from_titles(spark, sf):
    rid = F.col("c_custkey")
    text = rid.cast("string")
    title = F.when(rid % 4 == 0, F.concat(F.lit("BN59-"), text, F.lit("B оригинальный пульт для UE65"))).when(rid % 4 == 1, F.concat(F.lit("HDMI1, AA_"), text, F.lit("99; Пульт X"))).when(rid % 4 == 2, "no code here").otherwise(F.concat(F.lit("ab "), text, F.lit(" пульт")))
    ocr = F.when(rid % 8 == 0, F.concat(F.lit("BN59-"), text, F.lit("B"))).when(rid % 3 == 0, "OLD1")
    prints = table(spark, sf, "customer").select(rid.alias("rid"), ocr.alias("ocr"))
    named = table(spark, sf, "customer").where("c_custkey % 10 <> 9").select(rid.alias("rid"), title.alias("title")).withColumn("code", T.code_from_title(F.col("title")))
    met = prints.join(named, "rid", "left")
    status = F.when(F.col("title").isNull(), "absent").when(F.col("code").isNull(), "no_code").when(F.col("ocr").isNull(), "added").when(F.col("ocr") == F.col("code"), "agreed").otherwise("replaced")
    return met.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT a.doc_id AS photo, b.doc_id AS rid FROM p a JOIN p b USING (h) WHERE a.doc_id IN (SELECT doc_id FROM labels)")
def c17_truth_classes(spark, sf):
    products = table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), F.md5("text").alias("product"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("photo"), F.col("doc_id").alias("rid")).distinct()
    return K.truth_classes(labelled, products)


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_custkey IS NOT NULL THEN 'done' WHEN c_custkey % 5 = 0 THEN 'skipped' ELSE 'missing' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 0) ON c_custkey = o_custkey) GROUP BY status")
def c18_completeness(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    done = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("k"))
    return K.completeness(wanted, done, wanted.where("k % 5 = 0"), "k").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def c20_prune(spark, sf):
    source = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(source, "c_custkey", "left_anti")


@query(with_("urls") + "SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name FROM urls WHERE page_id % 2 = 0 EXCEPT SELECT regexp_extract(path, '[^/]*$') FROM urls WHERE page_id % 2 = 1")
def c21_excluded(spark, sf):
    names = urls(spark, sf).select("page_id", T.basename(F.col("path")).alias("name"))
    return names.where("page_id % 2 = 0").select("name").distinct().join(names.where("page_id % 2 = 1").select("name"), "name", "left_anti")


@query("SELECT p_name AS name, arg_min(p_type, (p_size, p_type)) AS directory FROM part GROUP BY p_name")
def c22_first_hit(spark, sf):
    parts = table(spark, sf, "part")
    places = parts.select(F.col("p_name").alias("name"), F.col("p_type").alias("directory"), F.struct("p_size", "p_type").alias("priority"))
    return K.first_hit(parts.select(F.col("p_name").alias("name")).distinct(), places, "name", "directory", "priority")


@query("SELECT p_brand AS cluster, count(*) AS members, count(DISTINCT p_type) AS kinds, min(p_partkey) AS canonical FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def c24_cluster_members(spark, sf):
    parts = table(spark, sf, "part")
    bridge = parts.where("p_size % 2 = 0").select(F.col("p_brand").alias("cluster"), "p_partkey")
    met = bridge.join(parts.select("p_partkey", "p_type"), "p_partkey")
    return met.groupBy("cluster").agg(F.count("*").alias("members"), F.countDistinct("p_type").alias("kinds"), F.min("p_partkey").alias("canonical"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def c29_missing_artefacts(spark, sf):
    there = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(there, "o_orderkey", "left_anti")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents")
def d8_content_dedupe(spark, sf):
    return K.content_dedupe(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text").cast("binary")).select("doc_id", "canonical", "copies")


@query("SELECT n, min_id, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY md5(text) HAVING count(*) > 1)) AS groups FROM (SELECT count(*) AS n, min(doc_id) AS min_id FROM documents GROUP BY md5(text) HAVING count(*) > 1) ORDER BY n DESC, min_id LIMIT 5")
def d9_duplicate_groups(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("min_id")).where("n > 1").select("n", "min_id")
    return g.orderBy(F.desc("n"), "min_id").limit(5).join(F.broadcast(g.agg(F.count("*").alias("groups"))))


@query(with_("urls") + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM urls GROUP BY 1")
def d35_dir_counts(spark, sf):
    return urls(spark, sf).groupBy(T.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))


VOCAB = "('the', 'of', 'and', 'der', 'die', 'que', 'les')"


@query(f"""SELECT doc_id, 3 * count(*) FILTER (WHERE hit) AS hits, round(3 * count(*) FILTER (WHERE hit) + sum(CASE WHEN length(line) >= 2 THEN conf * conf ELSE 0 END), 6) AS score FROM (
        SELECT doc_id, line, CAST(length(line) % 10 AS DOUBLE) / 10 AS conf, len(list_filter(string_split(line, ' '), lambda w: w IN {VOCAB})) > 0 AS hit
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id""")
def d29_text_score(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = F.exists(F.split("line", " "), lambda w: w.isin("the", "of", "and", "der", "die", "que", "les"))
    conf = (F.length("line") % 10).cast("double") / 10
    hits = 3 * F.count_if(hit)
    return lines.groupBy("doc_id").agg(hits.alias("hits"), F.round(hits + F.sum(F.when(F.length("line") >= 2, conf * conf).otherwise(0.0)), 6).alias("score"))


@query("SELECT p_partkey, nullif(regexp_replace(upper(p_name || '-' || p_brand), '[^A-Z0-9]+', '', 'g'), '') AS label, regexp_replace(upper(trim(p_type)), '[^A-Z0-9/:.+-]+', '', 'g') AS clean FROM part")
def h1_norm_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.norm_label(F.concat_ws("-", "p_name", "p_brand")).alias("label"), T.clean_text(F.col("p_type")).alias("clean"))


@query(
    f"""SELECT c_custkey AS rid, arg_max(replace(tok, ' ', '-'), (score, -i)) AS code FROM (
        SELECT c_custkey, tok, i, 1 + conf + CASE WHEN y > 0.75 THEN 0.5 ELSE 0 END + CASE WHEN contains(tok, '-') THEN 0.75 ELSE 0 END AS score FROM (
            SELECT c_custkey, CAST(c_custkey % 10 AS DOUBLE) / 10 AS conf, CAST(c_custkey % 4 AS DOUBLE) / 4 AS y, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (
                SELECT c_custkey, regexp_extract_all('HDMI2 VGA1 RM-D' || (c_custkey % 900 + 100) || ' BN59-0' || (c_custkey % 800 + 100) || 'B RM ' || (c_custkey % 50 + 10) || 'F', '{C.MODEL_PATTERN}') AS l FROM customer)))
        WHERE regexp_replace(tok, '[- ]', '', 'g') NOT IN ({WORDS}) AND length(regexp_replace(tok, '[- ]', '', 'g')) >= 5
              AND regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Z]') GROUP BY 1"""
)
def h2_model_code(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit("HDMI2 VGA1 RM-D"), (k % 900 + 100).cast("string"), F.lit(" BN59-0"), (k % 800 + 100).cast("string"), F.lit("B RM "), (k % 50 + 10).cast("string"), F.lit("F"))
    found = table(spark, sf, "customer").select(k.alias("rid"), F.posexplode(T.model_codes(text)).alias("i", "tok")).where(T.acceptable_code(F.col("tok")))
    y, conf = (F.col("rid") % 4).cast("double") / 4, (F.col("rid") % 10).cast("double") / 10
    score = 1 + conf + F.when(y > C.MODEL_BOTTOM, 0.5).otherwise(0.0) + F.when(F.col("tok").contains("-"), C.SEPARATOR).otherwise(0.0)
    return found.groupBy("rid").agg(F.max_by(F.translate("tok", " ", "-"), F.struct(score, -F.col("i"))).alias("code"))
