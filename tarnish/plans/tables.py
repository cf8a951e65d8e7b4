"""Queries that prepare catalogues, texts, prompts and run plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import prepare as P
from ..operators import prompts, selection
from ..sources.files import json_has_keys, verify_checksums
from ..sources.state import upsert_metrics
from .registry import query, table


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s6_json_catalog(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(json_has_keys(F.col("props"), ["k"]))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sha256(text) LIKE (CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN substr(sha256(text), 1, 8) ELSE 'zz' END) || '%' AS checksum_ok FROM documents")
def s7_checksums(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.withColumn("expected", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.substring(F.sha2("text", 256), 1, 8)).otherwise("zz"))
    return verify_checksums(d, "text", "expected").select("doc_id", "checksum_ok")


@query("SELECT n_name AS name, round(coalesce(n.m, o.m, 0), 2)::DOUBLE AS i_roc FROM nation LEFT JOIN (SELECT c_nationkey AS k, avg(c_acctbal) / 7 AS m FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1) n ON n.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, avg(s_acctbal) / 7 AS m FROM supplier GROUP BY 1) o ON o.k = n_nationkey")
def s9_metric_upsert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.avg("c_acctbal") / 7).alias("i_roc")).join(nation, "n_nationkey")
    old = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.avg("s_acctbal") / 7).alias("i_roc")).join(nation, "n_nationkey")
    return upsert_metrics(old, new, nation.select("name"), ["i_roc"])


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS label, CASE WHEN quality > 0 THEN 255 ELSE 0 END AS mask FROM labels")
def p1_p4_label_and_mask(spark, sf_dir):
    t = table(spark, sf_dir, "labels").withColumn("name", F.when(F.col("toxic") == 0, "normal").otherwise("anomaly"))
    return t.select("doc_id", P.normalize_label(F.col("name")).alias("label"), P.binarize(F.col("quality")).alias("mask"))


LAYOUT = """
WITH m AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN page_id % 3 = 0 THEN 'good' ELSE 'bad' END AS label, url AS image, url || '_mask' AS mask FROM pages)
SELECT image AS src, 'out/' || 'pages' || '/' || split || '/' || label || '/' || string_split(image, '/')[-1] AS dst,
  CASE WHEN {keep} THEN 'out/pages/ground_truth/' || label || '/' || string_split(mask, '/')[-1] END AS mask_dst FROM m
"""


def _layout(spark, sf_dir, mode):
    p = table(spark, sf_dir, "pages")
    m = p.select(F.lit("pages").alias("object"), F.when(F.col("page_id") % 4 == 0, "test").otherwise("train").alias("split"), F.when(F.col("page_id") % 3 == 0, "normal").otherwise("anomaly").alias("label"), F.col("url").alias("image"), F.concat("url", F.lit("_mask")).alias("mask"))
    return P.plan_layout(m, "out", mode).select("src", "dst", "mask_dst")


@query(LAYOUT.format(keep="split = 'test' AND label = 'bad'"))
def p2_layout_one_class(spark, sf_dir):
    return _layout(spark, sf_dir, "1cls")


@query(LAYOUT.format(keep="label = 'bad'"))
def p3_layout_two_class(spark, sf_dir):
    return _layout(spark, sf_dir, "2cls")


@query("SELECT doc_id, l.toxic AS mask, coalesce(l.toxic, 0) AS filled, l.doc_id IS NULL AS unpaired FROM documents d LEFT JOIN labels l USING (doc_id)")
def p5_p10_pair_masks(spark, sf_dir):
    d, m = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("mask"))
    lack = P.unpaired(d, m, ["doc_id"]).withColumn("unpaired", F.lit(True))
    return P.pair_masks(d, m, ["doc_id"]).join(lack, "doc_id", "left").select("doc_id", "mask", P.fill_mask(F.col("mask")).alias("filled"), F.coalesce("unpaired", F.lit(False)).alias("unpaired"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def p6_restrict_classes(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return P.restrict_classes(table(spark, sf_dir, "customer"), known, "c_nationkey").select("c_custkey")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def p6_unknown_classes(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return P.unknown_classes(table(spark, sf_dir, "customer"), known, "c_nationkey")


@query("SELECT l_returnflag AS split, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def p7_phase_split(spark, sf_dir):
    t = P.phase(table(spark, sf_dir, "lineitem"), "R", "l_returnflag")
    return t.groupBy(F.col("l_returnflag").alias("split")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT p_partkey, replace(p_brand, '#', '') || '-' || p_type || '-' || p_size::VARCHAR AS name, p_type AS middle FROM part")
def p8_sample_names(spark, sf_dir):
    t = table(spark, sf_dir, "part").withColumn("name", P.compose_name(F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_type"), F.col("p_size").cast("string")))
    return t.select("p_partkey", "name", P.parse_name(F.col("name"))[1].alias("middle"))


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS display FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 2")
def p9_display_names(spark, sf_dir):
    a = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("c"), F.col("n_name").alias("display"))
    t = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c"))
    return P.display_name(t, a, "c").select("c_custkey", "display")


@query("""WITH p AS (SELECT event_id, [value % 256, (value * 3) % 256, (value * 7) % 256] AS v FROM events),
s AS (SELECT event_id, [(v[1] / 255 - 0.48) / 0.27, (v[2] / 255 - 0.46) / 0.26, (v[3] / 255 - 0.41) / 0.28] AS s FROM p)
SELECT event_id, list_transform(s, lambda x: round(x, 6)) AS standard FROM s""")
def p11_standardize(spark, sf_dir):
    v = F.array(*[F.col("value") * k % 256 for k in (1, 3, 7)])
    s = P.standardize(v, [0.48, 0.46, 0.41], [0.27, 0.26, 0.28])
    return table(spark, sf_dir, "events").select("event_id", F.transform(s, lambda x: rounded(x, 6)).alias("standard"))


#: HTML entities that the oracle resolves; the texts have no others.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®", "&deg;": "°", "&middot;": "·", "&laquo;": "«", "&raquo;": "»", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&euro;": "€", "&nbsp;": " ", "&amp;": "&"}
CLEAN = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_ENT = "text"
for _ in range(2):
    for _k, _v in ENTITIES.items():
        _ENT = "replace({}, '{}', '{}')".format(_ENT, _k, _v.replace("'", "''"))
CLEAN_SQL = CLEAN.format(x=_ENT)


@query(f"SELECT doc_id, {CLEAN_SQL} AS clean FROM documents")
def p12_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({CLEAN_SQL}, '''s|''t|''re|''ve|''m|''ll|''d|\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]+')) AS token FROM documents) GROUP BY token")
def p13_token_counts(spark, sf_dir):
    return P.token_counts(table(spark, sf_dir, "documents"), "text")


@query()
def p14_subword_encode(spark, sf_dir, tokenizer="/opt/tokenizers/word_bpe_49k.json"):
    """Subword ids of every document (null and empty ones have none), with
    the merges of a public tokenizer file."""
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", P.pretokenize(P.clean_text(F.col("text"))).alias("words"))
    merges, vocab = P.read_subword_tables(spark, tokenizer)
    coded = P.subword_lists(d, merges, vocab, "words", as_bytes=True)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query("SELECT doc_id, trim(replace(array_to_string(list(token ORDER BY pos), ''), '</w>', ' ')) AS text FROM (SELECT doc_id, unnest([doc_id % 25, doc_id % 7, doc_id % 13]) AS id, unnest([0, 1, 2]) AS pos FROM documents) JOIN (SELECT n_nationkey AS id, lower(n_name) || '</w>' AS token FROM nation) USING (id) GROUP BY doc_id")
def p15_ids_to_text(spark, sf_dir):
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lower("n_name"), F.lit("</w>")).alias("token"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(*[F.col("doc_id") % k for k in (25, 7, 13)]).alias("ids"))
    return P.ids_to_text(d, v, "doc_id", "ids")


FRAMED = """WITH f AS (SELECT doc_id, list_concat([9001], (list_transform(string_split(text, ' '), lambda w: length(w)::INT))[1:14], [9002]) AS s FROM documents),
g AS (SELECT doc_id, list_resize(s, 16, 0) AS ids FROM f)"""


def _framed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.frame_sequence(F.transform(F.split("text", " ", -1), lambda w: F.length(w)), 16, 9001, 9002).alias("ids"))


@query(FRAMED + " SELECT doc_id, ids FROM g")
def p16_frame_sequence(spark, sf_dir):
    return _framed(spark, sf_dir)


@query(FRAMED + " SELECT doc_id, list_position(ids, list_max(ids))::BIGINT - 1 AS place, list_transform(ids, lambda i: i <> 0) AS mask FROM g")
def p17_p18_end_and_mask(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", P.end_position(F.col("ids")).cast("long").alias("place"), P.valid_mask(F.col("ids")).alias("mask"))


@query("SELECT p_brand, dense_rank() OVER (ORDER BY regexp_extract(p_brand, '(\\d+)')::INT)::BIGINT AS place FROM (SELECT DISTINCT p_brand FROM part)")
def p19_natural_sort(spark, sf_dir):
    """Place of each brand in natural order."""
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select("p_brand").distinct()  # as many rows as brands
    return brands.select("p_brand", F.dense_rank().over(Window.orderBy(P.natural_key(F.col("p_brand")))).cast("long").alias("place"))


@query("SELECT replace(lower(p_type), '-', '_') AS tag, list_sort(list(DISTINCT p_brand)) AS models FROM part GROUP BY 1")
def p20_tags(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.create_map("p_type", F.lit("x")).alias("tags"))
    return P.tag_catalog(m).groupBy("tag").agg(F.array_sort(F.collect_set("model")).alias("models"))  # by type, as many as brands


@query("SELECT r_name AS dataset, n_name AS class, shot FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 4])::INT AS shot)")
def k3_run_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name").collect()  # the class list
    classes: dict[str, list[str]] = {}
    for r in rows:
        classes.setdefault(r["r_name"], []).append(r["n_name"])
    return selection.run_grid(spark, classes, [1, 2, 4])


@query("SELECT o_custkey, epoch, value FROM (SELECT o_custkey, o_orderkey AS epoch, round(o_totalprice, -4) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def k5_best_epoch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), F.round("o_totalprice", -4).alias("value"))
    return selection.best_epoch(o, ["o_custkey"])


STATES = ", ".join(f"'{s}'" for s in prompts.GENERIC_STATES)
PROMPTS = f"""WITH c AS (SELECT DISTINCT p_brand AS class, replace(p_brand, '#', ' ') AS display FROM part),
t AS (SELECT class, display, unnest([{STATES}]) AS template FROM c UNION ALL SELECT class, display, '{{}} with ' || p_name FROM c JOIN part ON p_brand = class),
e AS (SELECT class, display, replace(template, '{{}}', display) AS prompt FROM t)"""


def _prompts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    classes = part.select(F.col("p_brand").alias("class"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("display")).distinct()
    specific = part.select(F.col("p_brand").alias("class"), F.concat(F.lit("{} with "), "p_name").alias("template"))
    return classes, prompts.expand_prompts(classes, prompts.GENERIC_STATES, specific)


@query(PROMPTS + " SELECT class, prompt, count(*) AS n FROM e GROUP BY 1, 2")
def t1_expand_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir)[1].groupBy("class", "prompt").agg(F.count("*").alias("n"))


@query(PROMPTS + """, n AS (SELECT DISTINCT class, display FROM e), r AS (
SELECT class, 'normal' AS kind, i AS copy, 'N N ' || display AS text FROM n, range(3) t(i) UNION ALL
SELECT class, 'state', i, 'N N ' || prompt FROM e, range(3) t(i) UNION ALL
SELECT class, 'learned', i, 'N N ' || display || ' A' FROM n, range(6) t(i))
SELECT class, kind, copy::INT AS copy, text, count(*) AS n FROM r GROUP BY ALL""")
def t2_replicate_prompts(spark, sf_dir):
    classes, every = _prompts(spark, sf_dir)
    out = prompts.replicate_prompts(every.join(classes, "class"), 2, 3, 1, 2)
    return out.groupBy("class", "kind", "copy", "text").agg(F.count("*").alias("n"))


@query(FRAMED + " SELECT doc_id, list_concat(ids[1:1], [-1, -2, -3], ids[5:]) AS ids FROM g")
def t3_splice_context(spark, sf_dir):
    ctx = F.array(*map(F.lit, (-1, -2, -3)))
    return _framed(spark, sf_dir).select("doc_id", prompts.splice_context(F.col("ids"), ctx, 3).alias("ids"))
