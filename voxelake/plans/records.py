"""Queries over element records, tags, manifests, colours and de-identification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelake.functions import scalar
from voxelake.operators import deid
from voxelake.plans.registry import query, table
from voxelake.sources import grids, packed, packed_source, part10
from voxelake.sources.shared import shared_dir
from voxelake.streaming import streams

TAG_SQL = "tg AS (SELECT p_partkey, (p_partkey * 7 % 65536) * 65536 + (p_size * 1031 % 65536) AS tag FROM part)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.tag(F.col("p_partkey") * 7 % 65536, F.col("p_size") * 1031 % 65536).alias("tag"))


@query("prj8_tag_format", f"WITH {TAG_SQL} SELECT p_partkey, tag, format('({{:04x}},{{:04x}})', tag // 65536, tag % 65536) AS text, (tag // 65536) % 2 = 1 AS private, tag % 65536 = 0 AS group_length FROM tg")
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tag")
    return tags(spark, sf_dir).select("p_partkey", "tag", scalar.format_tag(t).alias("text"), scalar.is_private(t).alias("private"), scalar.is_group_length(t).alias("group_length"))


#: A few known tags with their value representations (fixed values of the public dictionary).
DICTIONARY = [(0x00080060, "CS"), (0x00100010, "PN"), (0x00100020, "LO"), (0x0020000D, "UI"), (0x00280030, "DS"), (0x00280010, "US")]
DICT_SQL = f"dict(tag, vr) AS (VALUES {', '.join(map(str, DICTIONARY))})"

# elements: customers' and suppliers' columns as (entity, tag, vr, value)
ELEM_SQL = """el AS (SELECT c_custkey AS entity, 1048592 AS tag, 'PN' AS vr, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 1048608, 'LO', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 2097165, 'UI', CASE c_custkey % 3 WHEN 0 THEN '1.2.840.10008.' ELSE '1.3.46.' END || CAST(c_custkey // 2 AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 589825 + c_nationkey * 65536, 'SH', CAST(c_acctbal AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 1342177280 + c_nationkey, 'OW', 'curve' FROM customer)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    uid = F.concat(F.when(k % 3 == 0, "1.2.840.10008.").otherwise("1.3.46."), F.floor(k / 2).cast("string"))
    rows = F.array(
        *(
            F.struct(t.cast("long").alias("tag"), F.lit(vr).alias("vr"), v.alias("value"))
            for t, vr, v in (
                (F.lit(1048592), "PN", F.col("c_name")),
                (F.lit(1048608), "LO", F.col("c_mktsegment")),
                (F.lit(2097165), "UI", uid),
                (n * 65536 + 589825, "SH", F.col("c_acctbal").cast("string")),
                (n + 1342177280, "OW", F.lit("curve")),
            )
        )
    )
    return c.select(k.alias("entity"), F.explode(rows).alias("e")).select("entity", "e.*")


@query("join1_dictionary", f"WITH {ELEM_SQL}, {DICT_SQL} SELECT coalesce(dict.vr, 'UN') AS known, count(*) AS n, count(DISTINCT el.tag) AS tags FROM el LEFT JOIN dict USING (tag) GROUP BY 1")
def join1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag to value representation, UN by default; the dictionary is a fixed small table."""
    d = spark.createDataFrame(DICTIONARY, "tag long, known string")
    joined = elements(spark, sf_dir).join(F.broadcast(d), "tag", "left").withColumn("known", F.coalesce("known", F.lit("UN")))
    return joined.groupBy("known").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("tags"))


UID_SQL = "'2.25.' || CAST(CAST('0x' || substr(sha256('salt' || chr(0) || {0}), 1, 16) AS UHUGEINT) * 18446744073709551616::UHUGEINT + CAST('0x' || substr(sha256('salt' || chr(0) || {0}), 17, 16) AS UHUGEINT) AS VARCHAR)"
#: The published action table in small: parts' sizes decide what a tag of group 8 is to become.
TABLE_SQL = "act AS (SELECT DISTINCT 524288 + p_size AS tag, CASE p_size % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'X' WHEN 2 THEN 'Z' ELSE 'D' END AS action FROM part UNION SELECT 2097165, 'U' UNION SELECT 1048592, 'X')"
NEST_SQL = f"""{TABLE_SQL}, keep AS (SELECT 524288 + p_size AS tag FROM part WHERE p_size % 8 = 5), seqs AS (SELECT 524288 + p_size AS tag FROM part WHERE p_size % 16 = 4),
rem AS (SELECT tag FROM act WHERE action <> 'U' AND tag NOT IN (SELECT tag FROM keep) UNION SELECT tag FROM seqs), map AS (SELECT tag FROM act WHERE action = 'U' AND tag NOT IN (SELECT tag FROM seqs)),
ne AS (SELECT p_partkey AS entity, [CAST(x AS BIGINT) for x in CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [524288 + p_partkey % 50] ELSE [4194944 + 65536 * (p_partkey % 2), 524288 + p_partkey % 50] END] AS seq_path,
  CAST(CASE p_partkey % 5 WHEN 0 THEN 2097165 WHEN 1 THEN 1048592 WHEN 2 THEN 1342177280 + p_size WHEN 3 THEN 2686976 + p_size ELSE 524288 + p_size END AS BIGINT) AS tag, CASE p_partkey % 5 WHEN 0 THEN 'UI' ELSE 'LO' END AS vr,
  CASE p_size % 4 WHEN 0 THEN p_brand || '\\' || ' ' || '\\' || p_name WHEN 1 THEN '' ELSE p_name END AS value FROM part)"""
#: A tag goes: private, group length, curves, overlays, the pattern (0x0028, 0x00x0 to 0x00x7), or on the list.
GOES_SQL = "(({0} // 65536) % 2 = 1 OR {0} % 65536 = 0 OR {0} // 65536 BETWEEN 20480 AND 20735 OR {0} // 65536 BETWEEN 24576 AND 24831 OR ({0} // 65536 = 41 AND {0} % 16 < 8) OR {0} IN (SELECT tag FROM rem))"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elements within sequences: some private, some of curves, UIDs of one part, several or none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    path = F.when(k % 3 == 0, F.array()).when(k % 3 == 1, F.array(k % 50 + 524288)).otherwise(F.array(k % 2 * 65536 + 4194944, k % 50 + 524288)).cast("array<long>")
    tag = F.when(k % 5 == 0, 2097165).when(k % 5 == 1, 1048592).when(k % 5 == 2, size + 1342177280).when(k % 5 == 3, size + 2686976).otherwise(size + 524288).cast("long")
    value = F.when(size % 4 == 0, F.concat("p_brand", F.lit("\\ \\"), "p_name")).when(size % 4 == 1, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.alias("entity"), path.alias("seq_path"), tag.alias("tag"), F.when(k % 5 == 0, "UI").otherwise("LO").alias("vr"), value.alias("value"))


def action_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select("p_size").distinct()
    action = F.get(F.array(*map(F.lit, "UXZD")), size % 4)
    acts = parts.select((size + 524288).cast("long").alias("tag"), action.alias("action")).union(spark.createDataFrame([(2097165, "U"), (1048592, "X")], "tag long, action string"))
    some = lambda when: parts.filter(when).select((size + 524288).cast("long").alias("tag"))
    return deid.profile(acts, some(size % 8 == 5), some(size % 16 == 4))


@query("deid1_profile", f"WITH {NEST_SQL} SELECT tag, 'remove' AS fate FROM rem UNION ALL SELECT tag, 'remap' FROM map")
def deid1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published action table makes of each tag."""
    remove, remap = action_lists(spark, sf_dir)
    return remove.withColumn("fate", F.lit("remove")).union(remap.withColumn("fate", F.lit("remap")))


SCRUB_SQL = f"""{NEST_SQL}, fate AS (SELECT tag, {GOES_SQL.format('tag')} AS goes FROM (SELECT tag FROM ne UNION SELECT unnest(seq_path) FROM ne)),
sc AS (SELECT entity, seq_path, ne.tag, vr, CASE WHEN ne.tag IN (SELECT tag FROM map) AND len(list_filter(string_split(value, '\\'), lambda u: trim(u) <> '')) > 0
  THEN array_to_string(list_transform(list_filter(list_transform(string_split(value, '\\'), lambda u: trim(u)), lambda u: u <> ''), lambda u: {UID_SQL.format('u')}), '\\') ELSE value END AS value
  FROM ne JOIN fate USING (tag) WHERE NOT goes AND NOT list_has_any(seq_path, (SELECT list(tag) FROM fate WHERE goes)))"""


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deid.scrub(nested(spark, sf_dir), *action_lists(spark, sf_dir), [(0x0029, 0x0000, 0xFFFF, 0x0008)], "salt")


@query("deid2_scrub", f"WITH {SCRUB_SQL} SELECT entity, array_to_string(seq_path, '/') AS path, tag, vr, value FROM sc")
def deid2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested elements under a profile with a pattern; UIDs become hashes in decimals, blank parts go."""
    return scrubbed(spark, sf_dir).select("entity", F.array_join("seq_path", "/").alias("path"), "tag", "vr", "value")


@query("deid5_stamp", f"WITH {SCRUB_SQL}, ids AS (SELECT DISTINCT entity FROM sc), st AS (SELECT entity, path, tag, vr, value FROM ids, (VALUES ('', 1048592, 'PN', 'Doe^Demo'), ('', 1048608, 'LO', 'DEMO'), ('', 1179746, 'CS', 'YES'), ('', 1179747, 'LO', 'a\\b'), ('', 131090, 'UI', '2.25.1'), ('1179748', 524544, 'SH', '113100'), ('1179748', 524546, 'SH', 'DCM'), ('1179748', 524548, 'LO', 'Basic Application Confidentiality Profile')) v(path, tag, vr, value)), old AS (SELECT entity, array_to_string(seq_path, '/') AS path, tag, vr, value FROM sc) SELECT entity, path, CAST(tag AS BIGINT) AS tag, vr, value FROM (SELECT * FROM old UNION ALL SELECT * FROM st UNION ALL SELECT entity, '', CASE tag WHEN 524310 THEN 131074 ELSE 131075 END, vr, value FROM old WHERE path = '' AND tag IN (524310, 524312))")
def deid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrubbed elements with identity fields and file heads set."""
    e = deid.stamp(scrubbed(spark, sf_dir), "Doe^Demo", True, ["a", "b"], "2.25.1")
    return e.select("entity", F.array_join("seq_path", "/").alias("path"), "tag", "vr", "value")


@query("prj7_nested_path", f"WITH {NEST_SQL} SELECT entity, value FROM ne WHERE seq_path = [524288 + 5] AND tag = 2097165 UNION ALL SELECT entity, value FROM ne WHERE seq_path = [4194944, 524288 + 6] AND tag = 1048592")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements found by their path: one sequence down, and two."""
    e = nested(spark, sf_dir)
    return part10.at_path(e, 0x00080005, 0x0020000D).unionByName(part10.at_path(e, 0x00400280, 0x00080006, 0x00100010)).select("entity", "value")


@query("deid8_drop_named", f"WITH {NEST_SQL}, nm AS (SELECT DISTINCT 524288 + p_size AS tag FROM part WHERE p_size < 20) SELECT entity, array_to_string(seq_path, '/') AS path, tag, value FROM ne WHERE tag NOT IN (SELECT tag FROM nm) AND (tag // 65536) % 2 = 0 AND NOT list_has_any(seq_path, (SELECT list(tag) FROM nm)) AND len(list_filter(seq_path, lambda t: (t // 65536) % 2 = 1)) = 0")
def deid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements without a list of named tags and without private ones."""
    names = table(spark, sf_dir, "part").filter("p_size < 20").select((F.col("p_size") + 524288).cast("long").alias("tag"))
    return deid.drop_named(nested(spark, sf_dir), names).select("entity", F.array_join("seq_path", "/").alias("path"), "tag", "value")


@query("deid3_hash_hex", f"WITH {ELEM_SQL} SELECT entity, substr(sha256('salt' || chr(0) || value), 1, 32) AS hex FROM el WHERE vr = 'UI'")
def deid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).filter("vr = 'UI'").select("entity", deid.hashed_hex(F.col("value"), "salt").alias("hex"))


@query("deid3_hashed_uid", f"WITH {ELEM_SQL} SELECT entity, '2.25.' || CAST(CAST('0x' || substr(sha256('salt' || chr(0) || value), 1, 16) AS UHUGEINT) * 18446744073709551616::UHUGEINT + CAST('0x' || substr(sha256('salt' || chr(0) || value), 17, 16) AS UHUGEINT) AS VARCHAR) AS uid FROM el WHERE vr = 'UI'")
def deid3_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).filter("vr = 'UI'").select("entity", deid.hashed_uid(F.col("value"), "salt").alias("uid"))


@query("deid7_unmapped", f"WITH {ELEM_SQL} SELECT entity, value FROM el WHERE vr = 'UI' AND NOT starts_with(value, '1.2.840.10008.') AND NOT starts_with(value, '2.25.') AND value <> ''")
def deid7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deid.unmapped(elements(spark, sf_dir)).select("entity", "value")


FORBIDDEN = "f AS (SELECT DISTINCT lower(trim(text)) AS term FROM benchmark WHERE trim(text) <> '')"


def forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("term"))


@query("deid6_verify", f"WITH {FORBIDDEN} SELECT DISTINCT doc_id AS entity, term FROM documents JOIN f ON contains(lower(text), term)")
def deid6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden terms, whole benchmark texts, found in texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.lit(0).cast("long").alias("tag"), F.col("text").alias("value"))
    return deid.hits(d, forbidden(spark, sf_dir)).select("entity", "term")


@query("deid6_raw_bytes", "WITH n AS (SELECT DISTINCT lower(string_split(text, ' ')[3]) AS term FROM benchmark WHERE regexp_matches(string_split(text, ' ')[3], '^[A-Za-z]+$')) SELECT DISTINCT page_id AS entity, term FROM pages JOIN n ON contains(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), term)")
def deid6_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden words, each benchmark text's third, in raw bytes: half of the pages are stored as UTF-8, half as UTF-16."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("entity"), F.when(F.col("page_id") % 2 == 0, F.encode("html", "UTF-8")).otherwise(F.encode("html", "UTF-16LE")).alias("content"))
    word = F.get(F.split("text", " "), F.lit(2))
    return deid.byte_hits(p, table(spark, sf_dir, "benchmark").filter(word.rlike("^[A-Za-z]+$")).select(word.alias("term")))


@query("agg19_report", f"WITH {ELEM_SQL}, f AS (SELECT lower(n_name) AS term FROM nation) SELECT count(*) AS elements, count(DISTINCT entity) AS entities, count(*) FILTER (WHERE (tag // 65536) % 2 = 1) AS private_tags, count(*) FILTER (WHERE vr = 'UI') - count(DISTINCT value) FILTER (WHERE vr = 'UI') AS repeated_uids, count(*) FILTER (WHERE vr = 'UI' AND NOT starts_with(value, '1.2.840.10008.') AND value <> '') AS unmapped_uids, (SELECT count(*) FROM (SELECT DISTINCT entity, tag, term FROM el JOIN f ON contains(lower(value), term))) AS hits FROM el")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deid.report(elements(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")))


@query("deid9_forbidden_list", "SELECT DISTINCT lower(trim(p_name)) AS term FROM part WHERE trim(p_name) <> '' AND NOT starts_with(p_name, '#')")
def deid9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter((F.trim("p_name") != "") & ~F.col("p_name").startswith("#")).select(F.lower(F.trim("p_name")).alias("term")).distinct()


# --- value text and numbers ---

MULTI = "concat(CAST(l_quantity AS VARCHAR), '\\', CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE '2.5' END, '\\ 7 ')"


@query("prj6_numbers", "SELECT l_linenumber, l_quantity AS first, CASE l_linenumber % 3 WHEN 1 THEN 2 ELSE 3 END AS n, l_quantity + 7 + CASE l_linenumber % 3 WHEN 2 THEN 2.5 ELSE 0 END AS total, count(*) AS lines FROM lineitem GROUP BY 1, 2, 3, 4")
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-valued number texts: an empty part is 0, a word is left out."""
    k = F.col("l_linenumber") % 3
    raw = F.concat(F.col("l_quantity").cast("string"), F.lit("\\"), F.when(k == 0, "").when(k == 1, "abc").otherwise("2.5"), F.lit("\\ 7 "))
    t = table(spark, sf_dir, "lineitem").select("l_linenumber", raw.alias("raw")).groupBy("l_linenumber", "raw").agg(F.count("*").alias("lines")).withColumn("v", scalar.element_numbers(F.col("raw")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return t.select("l_linenumber", F.get("v", F.lit(0)).alias("first"), F.size("v").alias("n"), total.alias("total"), "lines")


@query("prj2_text", "SELECT p_partkey, nullif(regexp_replace(CASE p_size % 4 WHEN 0 THEN '  ' ELSE p_name || '  ' END, '[ ]+$', ''), '') AS text FROM part")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat("p_name", F.lit("  ")))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.element_text(raw).alias("text"))


@query("prj3_strings", "SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: trim(x))[1] AS first, len(string_split(p_name, ' ')) AS n FROM part")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalar.element_strings(F.replace(F.col("p_name"), F.lit(" "), F.lit("\\")))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(s, F.lit(0)).alias("first"), F.size(s).cast("long").alias("n"))


@query("fn_format_bytes", "WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10000) AS BIGINT) + 1 AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN format('{:.2f} GB', n / 1e9) WHEN n >= 1000000 THEN format('{:.0f} MB', n / 1e6) ELSE format('{:.0f} kB', n / 1e3) END AS size FROM b")
def fn_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * 10000) + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.format_bytes(n).alias("size"))


LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query("fn_luminance", f"WITH c AS (SELECT p_partkey, p_partkey * 2654435 % 16777216 AS v FROM part), l AS (SELECT p_partkey, 0.2126 * {LIN.format('(v // 65536)')} + 0.7152 * {LIN.format('(v // 256 % 256)')} + 0.0722 * {LIN.format('(v % 256)')} AS y FROM c) SELECT p_partkey, round(y, 6) AS luminance, round(1.05 / (y + 0.05), 6) AS on_white FROM l")
def fn_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative luminance of a colour and its contrast with white."""
    h = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 2654435 % 16777216)), 6, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h")).select("p_partkey", F.round(scalar.luminance(F.col("h")), 6).alias("luminance"), F.round(scalar.contrast(F.col("h"), F.lit("#ffffff")), 6).alias("on_white"))


@query("agg20_next_colour", "WITH p(ordinal, colour) AS (SELECT n, 'c' || CAST(n AS VARCHAR) FROM range(0, 8) r(n)), u AS (SELECT user_id, event_id % 8 AS ordinal, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1, 2), a AS (SELECT x.user_id, p.ordinal, colour, coalesce(u.n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) x CROSS JOIN p LEFT JOIN u ON u.user_id = x.user_id AND u.ordinal = p.ordinal) SELECT user_id, colour FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n, ordinal) = 1")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least used of eight colours, the first in palette order on ties: counted in one aggregation."""
    e = table(spark, sf_dir, "events")
    used = [F.struct(F.count_if((F.col("event_type") == "signup") & (F.col("event_id") % 8 == n)).alias("n"), F.lit(n).alias("ordinal")) for n in range(8)]
    return e.groupBy("user_id").agg(F.least(*used).alias("b")).select("user_id", F.concat(F.lit("c"), F.col("b.ordinal").cast("string")).alias("colour"))


# --- manifests: events stand for packed series ---

SERIES_SQL = "se AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'e' || event_id END AS name, CASE WHEN event_id % 13 = 0 THEN NULL ELSE [CAST(event_id % 5 AS INTEGER), 3, 4] END AS dims, CASE WHEN event_id % 7 = 0 THEN 'float' ELSE 'uint16' END AS kind, (event_id % 5) * 24 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS bytes, value AS step FROM events)"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest of one series an event, as JSON text; some names, sizes and types are wrong."""
    e = F.col("event_id")
    dims = F.when(e % 13 != 0, F.array((e % 5).cast("int"), F.lit(3), F.lit(4)))
    side = F.struct(F.lit("x.raw").alias("url"), (e % 5 * 24 + F.when(e % 17 == 0, 1).otherwise(0)).alias("bytes"), F.when(e % 7 == 0, "float").otherwise("uint16").alias("dataType"), dims.alias("dims"), F.array("value", "value", F.lit(2.0)).alias("spacing"), F.array(*(F.lit(0.0),) * 3).alias("origin"))
    series = F.struct(F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("e"), e.cast("string"))).alias("name"), side.alias("full"), side.alias("preview"))
    whole = F.struct(F.when(e % 19 == 0, "other").otherwise(packed.FORMAT).alias("format"), F.when(e % 23 != 0, F.array(series)).alias("series"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(whole).alias("text"))


@query("src13_manifest", f"WITH {SERIES_SQL} SELECT event_id, '' AS name, 'format' AS field, 'unknown' AS problem FROM se WHERE event_id % 19 = 0 UNION ALL SELECT event_id, '', 'series', 'no list' FROM se WHERE event_id % 23 = 0 UNION ALL SELECT event_id, name, f, 'missing or wrong' FROM (SELECT event_id, name, unnest(list_filter([CASE WHEN name = '' THEN 'name' END, CASE WHEN dims IS NULL OR dims[1] = 0 THEN 'dims' END, CASE WHEN step <= 0 THEN 'spacing' END, CASE WHEN kind = 'float' THEN 'dataType' END, CASE WHEN dims IS NULL OR bytes <> dims[1] * 24 THEN 'bytes' END], lambda x: x IS NOT NULL)) AS f FROM se WHERE event_id % 23 <> 0)")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is wrong with manifests, field by field."""
    parsed = manifests(spark, sf_dir).select("event_id", F.from_json("text", packed.MANIFEST).alias("m")).select("event_id", "m.*")
    return packed.problems(parsed, ["event_id"])


@query("src16_resolved", f"WITH {SERIES_SQL} SELECT event_id, name, 'base/x.raw' AS path, dims[1] AS nx, kind AS data_type FROM se WHERE event_id % 23 <> 0")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blobs of parsed manifests lie, and how to read them."""
    parsed = manifests(spark, sf_dir).select("event_id", F.from_json("text", packed.MANIFEST).alias("m")).select("event_id", F.explode("m.series").alias("s"))
    return packed.resolved("base/", parsed.select("event_id", "s.*"), ["event_id"]).select("event_id", "name", "path", F.get("dims", F.lit(0)).alias("nx"), "data_type")


@query("src14_sidecar", "WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT vec_id, round(abs(a) + 0.1, 9) AS spacing, round(b, 12) AS axis, vec_id % 3 > 0 AS has_center, 128 AS bytes FROM s")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars written as JSON and read again: rounded, with no window where there is none."""
    at = lambda n: F.get("embedding", F.lit(n)).cast("double")
    grid = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("volume_id"), F.array(F.lit(8), F.lit(8), F.lit(1)).alias("dims"), F.array(*((F.abs(at(0)) + 0.1),) * 3).alias("spacing"), F.array(at(2), at(3), at(4)).alias("origin"), F.array(*(F.array(at(1), at(1), at(1)),) * 3).alias("axes"),
        F.lit(False).alias("signed"), F.lit(0).alias("lo"), F.lit(4095).alias("hi"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), F.when(F.col("vec_id") % 3 > 0, 40.0).alias("center"), F.lit(None).cast("double").alias("width"), F.lit("d").alias("description"), F.lit("MR").alias("modality"), F.lit("").alias("frame_uid"), F.array().cast("array<string>").alias("warnings"),
    )
    text = grid.select("vec_id", F.to_json(packed.sidecar("x.raw")).alias("t"))
    back = F.from_json("t", packed.SIDECAR)
    return text.select("vec_id", back["spacing"][0].alias("spacing"), F.from_json("t", "axes array<array<double>>")["axes"][0][0].alias("axis"), F.col("t").contains("windowCenter").alias("has_center"), back["bytes"].cast("int").alias("bytes"))


SRC17_SQL = "WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding FROM embeddings), px AS (SELECT label, k, p // 8 AS j, p % 8 AS i, CAST(floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 2000 + 0.5) AS BIGINT) AS s FROM v, range(64) r(p)), h AS (SELECT label, k, j // 2 AS j, i // 2 AS i, CAST(floor(avg(s) + 0.5) AS BIGINT) AS s FROM px GROUP BY ALL), f AS (SELECT label, count(*) * 2 AS bytes, sum(s) AS total, max(k) + 1 AS nz FROM px GROUP BY 1), g AS (SELECT label, count(*) * 2 AS preview_bytes, sum(s) AS preview_total FROM h GROUP BY 1) SELECT '1.2.3.' || label AS name, CAST(nz AS INTEGER) AS nz, bytes, CAST(total AS BIGINT) AS total, preview_bytes, CAST(preview_total AS BIGINT) AS preview_total FROM f JOIN g USING (label)"


def label_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume for each label: its embeddings are the slices."""
    v = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    v = v.select("k", F.concat(F.lit("1.2.3."), F.col("label").cast("string")).alias("volume_id"), F.posexplode("embedding").alias("p", "x"))
    stored = F.floor((F.col("x").cast("double") + 1) * 2000 + 0.5).cast("int")
    return v.select("volume_id", "k", F.floor(F.col("p") / 8).cast("int").alias("j"), (F.col("p") % 8).cast("int").alias("i"), (F.col("k") * 64 + F.col("p")).cast("long").alias("idx"), stored.alias("stored"))


@query("src17_pack", SRC17_SQL)
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes packed as slab blobs with previews and a manifest, then read again."""
    voxels = label_volumes(spark, sf_dir)
    dims = grids.dims(voxels)
    out = None
    for name, own, size in (("", voxels, dims), ("preview_", *packed.halved(voxels, dims))):
        blobs = packed.slab_blobs(own, slab=16).join(size, "volume_id")
        parts = blobs.select("volume_id", (F.col("slab") * 16).alias("k0"), "nx", "ny", F.least(F.lit(16), F.col("nz") - F.col("slab") * 16).cast("int").alias("nz"), F.lit("uint16").alias("data_type"), "content")
        back = packed.voxels(parts).groupBy("volume_id").agg((F.count("*") * 2).alias(name + "bytes"), F.sum("stored").alias(name + "total"))
        out = back if out is None else out.join(back, "volume_id")
    return out.join(dims, "volume_id").select(F.col("volume_id").alias("name"), F.col("nz").cast("int").alias("nz"), "bytes", "total", "preview_bytes", "preview_total")


@query("src17_written_and_read", SRC17_SQL)
def src17_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same volumes written to files with previews and a manifest by the data source, and read by it."""
    voxels = label_volumes(spark, sf_dir)
    d = grids.dims(voxels).select("volume_id", F.array("nx", "ny", F.col("nz").cast("int")).alias("dims"))
    unit = F.array(*(F.array(*(F.lit(float(r == a)) for r in range(3))) for a in range(3)))
    fields = {"series_number": F.substring("volume_id", 7, 9).cast("int"), "spacing": F.array(*(F.lit(x) for x in (0.5, 0.5, 3.0))), "origin": F.array(*(F.lit(0.0),) * 3), "axes": unit, "signed": F.lit(False), "slope": F.lit(1.0), "intercept": F.lit(0.0), "center": F.lit(2000.0), "width": F.lit(None).cast("double"), "description": F.lit("d"), "modality": F.lit("MR"), "frame_uid": F.lit("1.2"), "warnings": F.array().cast("array<string>")}
    path = f"{shared_dir(spark)}/voxelake-{uuid.uuid4().hex}/packed"
    packed_source.write(d.withColumns(fields), voxels, path, slab=16)
    back = packed_source.read(spark, path, splitBytes="4096")
    own = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    out = packed_source.voxels_of(back).groupBy(F.col("volume_id").alias("name")).agg((F.max(F.when(F.col("kind") == "full", F.col("k"))) + 1).alias("nz"), (own("full", F.lit(2))).alias("bytes"), own("full", F.col("stored")).alias("total"), own("preview", F.lit(2)).alias("preview_bytes"), own("preview", F.col("stored")).alias("preview_total"))
    return out


@query("src20_codec_sizes", "SELECT '1.2.3.' || label AS volume_id, count(*) * 128 AS raw, true AS gzip_smaller, true AS zstd_smaller FROM embeddings GROUP BY label")
def src20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each volume's blobs as they are, and whether the codecs at hand shorten them."""
    sizes = packed.codec_sizes(packed.slab_blobs(label_volumes(spark, sf_dir), slab=16))
    return sizes.select("volume_id", "raw", (F.col("gzip") < F.col("raw")).alias("gzip_smaller"), (F.col("zstd") < F.col("raw")).alias("zstd_smaller"))


@query("src23_size_gate", "WITH p AS (SELECT page_id % 10 AS release, octet_length(encode(html)) AS n FROM pages) SELECT release, count(*) AS files, sum(CAST(n > 4000 AS INTEGER)) AS too_large, sum(CAST(n > 3500 AND n <= 4000 AS INTEGER)) AS close, max(n) AS largest, CASE WHEN max(n) > 4000 OR count(*) > 25 THEN 'fail' WHEN max(n) > 3500 THEN 'warn' ELSE 'ok' END AS verdict FROM p GROUP BY 1")
def src23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the files of ten releases: limits on a file's bytes and on the number of files."""
    files = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("release"), F.octet_length("html").alias("bytes"))
    return packed.size_gate(files, "release", limit=4000, warn=3500, most_files=25)


@query("src4_study_listing", "WITH p AS (SELECT page_id, split_part(url, '/', 3) AS series, 'img' || CAST(page_id % 100 AS VARCHAR) || '.dcm' AS file FROM pages) SELECT series AS name, count(*) AS n, arg_min(file, (page_id % 100, page_id)) AS first FROM p GROUP BY 1")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a listing by folder, files in the order of their numbers; the pages' hosts stand for folders."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("root/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/img"), (F.col("page_id") % 100).cast("string"), F.lit(".dcm")).alias("path"))
    s = packed.listing(p, "root")
    return s.select("name", F.size("files").cast("long").alias("n"), F.element_at(F.split(F.get("files", F.lit(0)), "/"), -1).alias("first"))


@query("src21_reference_digest", "WITH b AS (SELECT label, vec_id // 65536 AS block, count(*) AS n, sum(CAST(embedding[1] AS DOUBLE)) AS total, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS h FROM embeddings GROUP BY 1, 2) SELECT label, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 6) AS total, sha256(string_agg(h, ',' ORDER BY block)) AS digest FROM b GROUP BY label")
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of a set: count, sum and a digest of its members in order, by blocks of ids and then of the blocks."""
    e = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 65536))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    b = e.groupBy("label", "block").agg(F.count("*").alias("n"), F.sum(F.get("embedding", F.lit(0)).cast("double")).alias("total"), F.sha2(ids, 256).alias("h"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"])
    return b.groupBy("label").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"), F.sha2(F.array_join(hashes, ","), 256).alias("digest"))


@query("stream_activity", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1, 2")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, counted by a stream with a watermark."""
    return streams.activity(spark, f"{sf_dir}/events.parquet")


@query("agg18_progress", "SELECT user_id, round(sum(value), 4) AS done, CASE WHEN bool_and(event_id % 29 > 0) THEN round(least(1.0, sum(value) / sum(500)), 6) END AS fraction FROM events GROUP BY 1")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed progress; no fraction where any part's total is unknown, as one in 29 is."""
    e = table(spark, sf_dir, "events").withColumn("total", F.when(F.col("event_id") % 29 > 0, 500.0))
    done, fraction = scalar.progress(F.col("value"), F.col("total"))
    return e.groupBy("user_id").agg(F.round(done, 4).alias("done"), F.round(fraction, 6).alias("fraction"))


LAB = "WITH p AS (SELECT p_partkey, p_partkey * 2654435 % 16777216 AS v FROM part), c AS (SELECT p_partkey, {r} AS r, {g} AS g, {b} AS b FROM p), l AS (SELECT p_partkey, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM c), o AS (SELECT p_partkey, 0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s AS x, 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s AS y, 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s AS z FROM l)"


@query("fn_oklab", LAB.format(r=LIN.format("(v // 65536)"), g=LIN.format("(v // 256 % 256)"), b=LIN.format("(v % 256)")) + ", w AS (SELECT 0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s AS wx, 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s AS wy, 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s AS wz FROM (SELECT cbrt(CAST(0.4122214708 AS DOUBLE) + 0.5363325363 + 0.0514459929) AS l, cbrt(CAST(0.2119034982 AS DOUBLE) + 0.6806995451 + 0.1073969566) AS m, cbrt(CAST(0.0883024619 AS DOUBLE) + 0.2817188376 + 0.6299787005) AS s)) SELECT p_partkey, round(x, 5) AS light, round(y, 5) + 0.0 AS a, round(z, 5) + 0.0 AS b, round(sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy) + (z - wz) * (z - wz)), 4) AS from_white FROM o, w")
def fn_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as the eye sees them, and their distance from white."""
    h = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 2654435 % 16777216)), 6, "0"))
    light, a, b = scalar.oklab(F.col("h"))
    far = scalar.colour_distance(F.col("h"), F.lit("#ffffff"))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h")).select("p_partkey", F.round(light, 5).alias("light"), (F.round(a, 5) + 0.0).alias("a"), (F.round(b, 5) + 0.0).alias("b"), F.round(far, 4).alias("from_white"))


@query("topk_seed", "SELECT user_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def topk_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cut with a part of each session, by one aggregation."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("b")).select("user_id", F.col("b.event_id").alias("event_id"))
