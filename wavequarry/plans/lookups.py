"""Lookups, coverage checks and grouped summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavequarry.functions.naming import schema_hash
from wavequarry.operators import quantiles


def table(spark, sf_dir, name):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):  # noqa: ANN001, ANN201
    return F.round(c, 6)


def share(condition):  # noqa: ANN001, ANN201
    """Share of rows that meet a condition; null counts as not meeting it."""
    return r6(F.avg(F.coalesce(condition, F.lit(False)).cast("double")))


def role_regex_projection(spark, d):  # noqa: ANN001, ANN201
    p = r"^(Brand)#([0-9])([0-9]+)$"
    return table(spark, d, "part").select(
        "p_partkey",
        F.nullif(F.regexp_extract("p_brand", p, 1), F.lit("")).alias("prefix"),
        F.nullif(F.regexp_extract("p_brand", p, 3), F.lit("")).alias("contact_text"),
        F.nullif(F.regexp_extract("p_brand", p, 2), F.lit("")).cast("int").alias("contact_number"),
        F.when(F.col("p_brand").rlike("^Brand#1[0-9]$"), "auxiliary").when(F.col("p_brand").rlike(p), "candidate").otherwise("unknown").alias("role"),
    )


def role_counts(spark, d):  # noqa: ANN001, ANN201
    role = F.when(F.col("p_brand").rlike("^Brand#1[0-9]$"), "auxiliary").otherwise("candidate")
    return table(spark, d, "part").groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("codes"), F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("code_list"))


def label_inner_lookup(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "lang", "n_chars")


def label_left_lookup(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("quality"), F.col("toxic"))


def unlabelled_documents(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


def labelled_documents(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


def id_coverage_difference(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("o")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"))
    return o.join(c, F.col("o") == F.col("c"), "full").where("o is null or c is null").select(F.coalesce("o", "c").alias("custkey"), F.when(F.col("o").isNull(), "no_order").otherwise("unknown_customer").alias("problem"))


def id_intersection(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


def id_subtraction(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey")).subtract(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("partkey")))


def union_duplicate_check(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "labels")
    return x.where("toxic = 0").unionByName(x.where("quality = 1")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def dataset_profile(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").agg(
        F.count("*").alias("n"),
        share(F.col("lang") == "en").alias("en_share"),
        F.min("n_chars").alias("least"),
        F.median("n_chars").alias("middle"),
        F.max("n_chars").alias("most"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
        F.countDistinct("source").alias("sources"),
        F.bool_and(F.col("text").isNotNull()).alias("complete"),
    )


def beside_distinct(x, key, counted, name, *others):  # noqa: ANN001, ANN201
    """Groups with a distinct count and other aggregates, each in a pass of its own: in one, Spark keeps the others' values for every value counted."""
    few = x.where(F.col(counted).isNotNull()).select(F.col(key).alias("_key"), counted).distinct().groupBy("_key").agg(F.count("*").alias(name))
    g = x.groupBy(key).agg(*others).join(few, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return g.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def record_profile(spark, d):  # noqa: ANN001, ANN201
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(share(v == 0).alias("zero_rate"), F.min(v).alias("least"), F.max(v).alias("most"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("deviation"), F.countDistinct("user_id").alias("users"), (F.count("*") == F.countDistinct("event_id")).alias("unique_ids"))


def schema_frequency(spark, d):  # noqa: ANN001, ANN201
    per_user = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("schema"))
    return per_user.groupBy("schema").agg(F.count("*").alias("n"))


def group_summary_form(spark, d):  # noqa: ANN001, ANN201
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.median(v)).alias("middle"), r6(F.avg(v)).alias("mean"), share(v > 10).alias("over10"), share(v > 20).alias("over20"), share(v > 100).alias("over100"))


def group_summary_code(spark, d):  # noqa: ANN001, ANN201
    """Medians are selected by histograms, so that no task holds the prices of a flag; a price that is not a number ranks as infinite."""
    v = F.col("l_extendedprice")
    x = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice")
    price = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
    middle = quantiles.quantiles(x.select("l_returnflag", price.alias("price")), ["l_returnflag"], "price", [0.5]).select(F.col("l_returnflag").alias("_flag"), r6(F.col("q")[0]).alias("middle"))
    g = beside_distinct(x, "l_returnflag", "l_orderkey", "orders", F.count("*").alias("n"), share(v > 30000).alias("high_share"))
    g = g.join(middle, F.col("l_returnflag").eqNullSafe(F.col("_flag")), "left")
    return g.select("l_returnflag", "n", "orders", "middle", "high_share").orderBy(F.desc("middle"), F.desc("n"))


def group_role_summary(spark, d):  # noqa: ANN001, ANN201
    g = beside_distinct(table(spark, d, "lineitem"), "l_linestatus", "l_suppkey", "suppliers", F.count("*").alias("n"), r6(F.median("l_quantity")).alias("middle"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), r6(F.median("l_discount")).alias("middle_discount"), r6(F.avg("l_tax")).alias("mean_tax"))
    return g.select("l_linestatus", "n", "suppliers", "middle", "least", "most", "middle_discount", "mean_tax")


def having_topk_groups(spark, d):  # noqa: ANN001, ANN201
    g = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), r6(F.median("p_retailprice")).alias("middle")).where("n >= 10")
    return g.orderBy(F.desc("middle"), "p_type").limit(12)


def alignment_summary(spark, d):  # noqa: ANN001, ANN201
    e = F.abs(F.col("l_quantity") - 25.0)
    g = beside_distinct(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "records", r6(F.median(e)).alias("median_error"), r6(F.avg(e)).alias("mean_error"), F.min(e).alias("least_error"), share(e <= 5).alias("hit5"), share(e <= 10).alias("hit10"), share(F.col("l_discount") > 0.05).alias("positive_rate"))
    return g.select("l_suppkey", "records", "median_error", "mean_error", "least_error", "hit5", "hit10", "positive_rate")


def label_list_unpivot(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "nation").selectExpr("n_nationkey", "cast(n_regionkey as bigint) ch1", "cast(n_nationkey as bigint) ch2")
    return x.unpivot("n_nationkey", ["ch1", "ch2"], "rank", "channel")


def channel_schema_hash(spark, d):  # noqa: ANN001, ANN201
    ids = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(schema_hash(ids).alias("schema_group"))


def onset_latency(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") * 2000.0 + 1.0).alias("latency"))


def split_column_prune(spark, d):  # noqa: ANN001, ANN201
    """Of all suppliers; only the two columns that it needs are read."""
    return table(spark, d, "supplier").select("s_suppkey", F.split_part("s_name", F.lit("#"), F.lit(1)).alias("split"))


def split_column_whole(spark, d):  # noqa: ANN001, ANN201
    """The same rows under the name that the whole table had while split_column_prune took four suppliers."""
    return split_column_prune(spark, d)


QUERIES = {f.__name__: f for f in (
    role_regex_projection, role_counts, label_inner_lookup, label_left_lookup, unlabelled_documents, labelled_documents, id_coverage_difference,
    id_intersection, id_subtraction, union_duplicate_check, dataset_profile, record_profile, schema_frequency, group_summary_form, group_summary_code,
    group_role_summary, having_topk_groups, alignment_summary, label_list_unpivot, channel_schema_hash, onset_latency, split_column_prune, split_column_whole,
)}

ORACLES = {
    "role_regex_projection": r"""SELECT p_partkey, nullif(regexp_extract(p_brand,'^(Brand)#([0-9])([0-9]+)$',1),'') AS prefix,
        nullif(regexp_extract(p_brand,'^(Brand)#([0-9])([0-9]+)$',3),'') AS contact_text,
        CAST(nullif(regexp_extract(p_brand,'^(Brand)#([0-9])([0-9]+)$',2),'') AS INT) AS contact_number,
        CASE WHEN regexp_matches(p_brand,'^Brand#1[0-9]$') THEN 'auxiliary' WHEN regexp_matches(p_brand,'^(Brand)#([0-9])([0-9]+)$') THEN 'candidate' ELSE 'unknown' END AS role FROM part""",
    "role_counts": r"""SELECT role, count(*) AS n, count(DISTINCT p_brand) AS codes, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS code_list
        FROM (SELECT p_brand, CASE WHEN regexp_matches(p_brand,'^Brand#1[0-9]$') THEN 'auxiliary' ELSE 'candidate' END AS role FROM part) GROUP BY role""",
    "label_inner_lookup": "SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l JOIN documents d USING (doc_id)",
    "label_left_lookup": "SELECT d.doc_id, source, coalesce(CAST(quality AS DOUBLE), 0.0::DOUBLE) AS quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "unlabelled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "labelled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "id_coverage_difference": """SELECT coalesce(o, c) AS custkey, CASE WHEN o IS NULL THEN 'no_order' ELSE 'unknown_customer' END AS problem
        FROM (SELECT DISTINCT o_custkey AS o FROM orders) FULL JOIN (SELECT c_custkey AS c FROM customer) ON o = c WHERE o IS NULL OR c IS NULL""",
    "id_intersection": "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "id_subtraction": "SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "union_duplicate_check": "SELECT doc_id, count(*) AS n FROM (SELECT * FROM labels WHERE toxic = 0 UNION ALL SELECT * FROM labels WHERE quality = 1) GROUP BY doc_id HAVING count(*) > 1",
    "dataset_profile": """SELECT count(*) AS n, round(avg(CAST(lang = 'en' AS DOUBLE)), 6) AS en_share, min(n_chars) AS least, median(n_chars) AS middle, max(n_chars) AS most,
        string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT source) AS sources, bool_and(text IS NOT NULL) AS complete FROM documents""",
    "record_profile": """SELECT event_type, round(avg(CAST(value = 0 AS DOUBLE)), 6) AS zero_rate, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS deviation, count(DISTINCT user_id) AS users, count(*) = count(DISTINCT event_id) AS unique_ids FROM events GROUP BY event_type""",
    "schema_frequency": "SELECT schema, count(*) AS n FROM (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS schema FROM events GROUP BY user_id) GROUP BY schema",
    "group_summary_form": """SELECT event_type, count(*) AS n, round(median(value), 6) AS middle, round(avg(value), 6) AS mean, round(avg(CAST(value > 10 AS DOUBLE)), 6) AS over10,
        round(avg(CAST(value > 20 AS DOUBLE)), 6) AS over20, round(avg(CAST(value > 100 AS DOUBLE)), 6) AS over100 FROM events GROUP BY event_type""",
    "group_summary_code": """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(median(l_extendedprice), 6) AS middle,
        round(avg(CAST(l_extendedprice > 30000 AS DOUBLE)), 6) AS high_share FROM lineitem GROUP BY l_returnflag ORDER BY middle DESC, n DESC""",
    "group_role_summary": """SELECT l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(median(l_quantity), 6) AS middle, min(l_quantity) AS least,
        max(l_quantity) AS most, round(median(l_discount), 6) AS middle_discount, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY l_linestatus""",
    "having_topk_groups": "SELECT p_type, count(*) AS n, round(median(p_retailprice), 6) AS middle FROM part GROUP BY p_type HAVING count(*) >= 10 ORDER BY middle DESC, p_type LIMIT 12",
    "alignment_summary": """SELECT l_suppkey, count(DISTINCT l_orderkey) AS records, round(median(e), 6) AS median_error, round(avg(e), 6) AS mean_error, min(e) AS least_error,
        round(avg(CAST(e <= 5 AS DOUBLE)), 6) AS hit5, round(avg(CAST(e <= 10 AS DOUBLE)), 6) AS hit10, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS positive_rate
        FROM (SELECT *, abs(l_quantity - 25.0::DOUBLE) AS e FROM lineitem) GROUP BY l_suppkey""",
    "label_list_unpivot": """SELECT n_nationkey, 'ch1' AS rank, CAST(n_regionkey AS BIGINT) AS channel FROM nation UNION ALL SELECT n_nationkey, 'ch2', CAST(n_nationkey AS BIGINT) FROM nation""",
    "channel_schema_hash": "SELECT user_id, substr(sha1(string_agg(event_type, chr(0) ORDER BY event_id)), 1, 8) AS schema_group FROM events GROUP BY user_id",
    "onset_latency": "SELECT l_orderkey, l_linenumber, round(l_quantity * 2000.0::DOUBLE + 1.0::DOUBLE, 6) AS latency FROM lineitem",
    "split_column_prune": "SELECT s_suppkey, split_part(s_name, '#', 1) AS split FROM supplier",
    "split_column_whole": "SELECT s_suppkey, split_part(s_name, '#', 1) AS split FROM supplier",
}
