"""Registered queries: each operator on the driver's tables, and the same in SQL.

The tables aren't records, so each operator runs on an analogue: documents stand for records with
their text as search text and doc_id as sequence, events for uses of names, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import intro, library, pages, search, stats, upsert, users
from ..sources import store
from ..streaming import sync
from . import postings
from .registry import query, shared
from .registry import read as _read

_NORM = r"regexp_replace(lower(text), '[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')"


#: Where the search texts of a table were stored, by application and folder.
_STORED: dict[tuple[str, str], str] = {}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, norm): the stored search texts of documents. They are made once, by the first query of a
    session that needs them; all searches read the stored column, as they do in a collection."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _STORED:
        path = shared(spark, "search-texts")
        store.put(_read(spark, sf_dir, "documents").select("doc_id", fn.normalized(F.col("text")).alias("norm")), path)
        _STORED[own] = path
    return store.read(spark, _STORED[own], "doc_id long, norm string")


def _selected(spark: SparkSession, sf_dir: str, filters=(), bans=(), **more) -> DataFrame:
    return search.select(_texts(spark, sf_dir), filters, bans, text="norm", seq="doc_id", **more).select("doc_id")


def _matching(where: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WHERE {where}"


@query(_matching("contains(norm, 'the') AND contains(norm, 'que')"))
def select_all_terms(spark, sf_dir):
    return _selected(spark, sf_dir, ["The", "qu e"])


@query(_matching("contains(norm, 'the')"))
def select_one_term(spark, sf_dir):
    return _selected(spark, sf_dir, ["the"])


@query(_matching("contains(norm, 'license') AND contains(norm, 'the')"))
def select_rare_verify(spark, sf_dir):
    found = search.select_by_verification(_texts(spark, sf_dir), ["the", "license"], text="norm", key="doc_id")
    return found.orderBy(F.desc("doc_id"))


@query(_matching("NOT contains(norm, 'the') AND NOT contains(norm, 'que')"))
def select_ban_only(spark, sf_dir):
    return _selected(spark, sf_dir, (), ["the", "que"])


@query(_matching("contains(norm, 'the') AND NOT contains(norm, 'que')"))
def select_mixed(spark, sf_dir):
    return _selected(spark, sf_dir, ["the"], ["que"])


@query("SELECT doc_id FROM documents")
def select_no_terms(spark, sf_dir):
    return _selected(spark, sf_dir)


@query("SELECT doc_id FROM documents WHERE false")
def select_disabled(spark, sf_dir):
    return _selected(spark, sf_dir, ["the"], disabled=True)


@query(_matching("contains(norm, '$s2') AND contains(norm, 'the')") + " UNION ALL " + _matching("contains(norm, '%%%') AND contains(norm, '_') IS NOT NULL AND contains(norm, '$$$')"))
def select_literal(spark, sf_dir):
    return _selected(spark, sf_dir, ["the"], safe=True, ordered=False).unionByName(_selected(spark, sf_dir, ["%%%", "$$$"], ordered=False))


@query(_matching("contains(norm, 'the') AND contains(norm, 'and') AND NOT contains(norm, 'que')"))
def select_by_sets(spark, sf_dir):
    return search.select_by_sets(_texts(spark, sf_dir), ["the", "and"], ["que"], text="norm", key="doc_id")


@query(_matching("contains(norm, 'license') AND NOT contains(norm, 'que')"))
def select_by_postings(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return postings.select(texts, postings.build(texts, "norm", "doc_id"), ["license"], ["que"], "norm", "doc_id").select("doc_id")


@query(_matching("contains(norm, 'xq') AND contains(norm, 'the')"))
def select_planned(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return postings.planned(texts, postings.build(texts, "norm", "doc_id"), ["the", "xq"], (), "norm", "doc_id").select("doc_id")


_FLAGGED = r"""
SELECT d.doc_id, '\$s' || (2 * q + 2 * t) || '\$x' || t || '\$r' || (t + (2 * q + 2 * t) // 2)
  || CASE WHEN 2 * q + 2 * t <> 2 THEN '\$n' ELSE '' END || CASE WHEN 2 * q + 2 * t >= 6 THEN '\$h' ELSE '' END
  || CASE WHEN n_chars >= 1000 THEN '\$w' ELSE '' END || CASE WHEN n_chars >= 1000 OR p > 1 THEN '\$l' ELSE '' END
  || CASE WHEN n_chars <= 1000 THEN '\$t' ELSE '' END AS flags
FROM (SELECT doc_id, n_chars, n_chars % 3 + 1 AS p FROM documents) d
JOIN (SELECT doc_id AS i, max(quality) + 0 AS q, max(toxic) AS t FROM labels GROUP BY doc_id) l ON d.doc_id = l.i"""


def _flagged(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    sanity = 2 * F.col("q") + 2 * F.col("t")
    return rows.select("doc_id", intro.flags(sanity, F.col("t"), F.col("n_chars"), F.lit(1000), F.col("n_chars") % 3 + 1).alias("flags"))


@query(_FLAGGED)
def flag_tokens(spark, sf_dir):
    return _flagged(spark, sf_dir)


@query(rf"SELECT doc_id FROM ({_FLAGGED}) WHERE contains(flags, '$s2') AND contains(flags, '$w') AND NOT contains(flags, '$t')")
def select_flags(spark, sf_dir):
    return search.select(_flagged(spark, sf_dir), ["$w"], ["$t"], text="flags", seq="doc_id", safe=True).select("doc_id")


@query(f"SELECT doc_id, md5({_NORM}) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    rows = fn.computed_once(_read(spark, sf_dir, "documents").select("doc_id", "text"), norm=fn.normalized(F.col("text")))
    return rows.select("doc_id", F.md5("norm").alias("norm_md5"))


_PRIMARY = """
SELECT user_id, event_type AS primary_name FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(event_id)) AS r
  FROM events GROUP BY user_id, event_type) WHERE r = 1"""


def _names(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("user_name"))


@query(_PRIMARY)
def primary_name(spark, sf_dir):
    return users.primary_names(_names(spark, sf_dir), seq="event_id")


@query(f"SELECT event_id, CASE WHEN event_type = primary_name THEN 'k' ELSE event_type || ',k' END AS tags FROM events JOIN ({_PRIMARY}) USING (user_id)")
def aliased_tags(spark, sf_dir):
    names = _names(spark, sf_dir)
    rows = users.with_primary(names.withColumn("tags", F.array(F.lit("k"))), users.primary_names(names, seq="event_id"))
    return rows.select("event_id", F.array_join("tags", ",").alias("tags"))


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w, 0)::INTEGER AS filled
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward_dims(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text")).alias("filled"))
    return pages.fill_forward(rows, "conv_id", "turn", "filled")


def _files(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), F.col("doc_id").alias("iid"))
    have = _read(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id")).alias("filename"))
    missing = docs.filter(F.col("iid") % 7 == 0).select("filename")
    return docs, have, missing


@query("SELECT doc_id AS iid, 'f' || doc_id AS filename FROM documents d WHERE doc_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def download_queue(spark, sf_dir):
    return library.download_queue(*_files(spark, sf_dir)).select("iid", "filename")


@query("SELECT count(*) AS skipped FROM documents d WHERE doc_id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def queue_skipped(spark, sf_dir):
    return library.skipped_count(*_files(spark, sf_dir))


@query("SELECT event_id AS pos, doc_id AS iid FROM events JOIN documents ON doc_id = user_id WHERE doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_queue(spark, sf_dir):
    docs, have, missing = _files(spark, sf_dir)
    pending = _read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("iid")).join(docs.select("iid"), "iid", "left_semi")
    return library.pending_queue(pending, docs, have, missing).select("pos", "iid")


@query("SELECT 'f' || doc_id AS filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    docs, have, _ = _files(spark, sf_dir)
    return library.orphans(docs.select("filename"), have)


@query("""
SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer FROM documents)
WHERE newer > 300000""")
def lru_evict(spark, sf_dir):
    files = _read(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias("filename"), F.col("n_chars").alias("size"), F.col("doc_id").alias("accessed"))
    return library.evict(files, 300_000, days=10_000).select(F.col("filename").cast("long").alias("doc_id"))


@query("SELECT user_id, max(ts) AS accessed FROM events WHERE event_type <> 'click' GROUP BY user_id")
def recency(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("event_type <> 'click'").select(F.col("user_id").alias("filename"), F.col("ts").alias("accessed"))
    return library.touch(e.groupBy("filename").agg(F.min("accessed").alias("accessed")), e).withColumnRenamed("filename", "user_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return upsert.latest(e, ["user_id", "event_type"], "event_id")


def _sides(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("iid"), F.col("event_type").alias("intro"), F.col("props").alias("raw"), (F.col("value") > 20).alias("visible"))
    cut = F.col("event_id") % 3 > 0
    return upsert.latest(e.filter(~cut), ["iid"], "event_id"), upsert.latest(e.filter(cut & (F.col("iid") % 5 > 0)), ["iid"], "event_id")


_SIDES = """
WITH e AS (SELECT event_id, user_id AS iid, event_type AS intro, props AS raw, value > 20 AS visible, event_id % 3 > 0 AS cut FROM events),
incoming AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY event_id DESC) AS r FROM e WHERE NOT cut) WHERE r = 1),
existing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY event_id DESC) AS r FROM e WHERE cut AND iid % 5 > 0) WHERE r = 1)"""


@query(_SIDES + """
SELECT n.iid, CASE WHEN o.iid IS NULL THEN 'New' WHEN NOT n.visible THEN 'Hidden' WHEN n.raw = o.raw THEN 'Skipped'
  WHEN n.intro = o.intro THEN 'IntroUnchanged' ELSE 'IntroChanged' END AS status
FROM incoming n LEFT JOIN existing o ON n.iid = o.iid""")
def change_class(spark, sf_dir):
    incoming, existing = _sides(spark, sf_dir)
    return upsert.classify(incoming, existing, existing).select("iid", "status")


@query(_SIDES + """
, s AS (SELECT n.iid, n.event_id, CASE WHEN o.iid IS NULL THEN 'New' WHEN NOT n.visible THEN 'Hidden' WHEN n.intro = o.intro THEN 'IntroUnchanged' ELSE 'IntroChanged' END AS status
  FROM incoming n LEFT JOIN existing o ON n.iid = o.iid)
SELECT status, count(*) AS n, string_agg(iid::VARCHAR, ',' ORDER BY event_id) AS ids FROM s GROUP BY status""")
def change_counts(spark, sf_dir):
    incoming, existing = _sides(spark, sf_dir)
    return upsert.change_report(upsert.classify(incoming, existing), "event_id").withColumn("ids", F.array_join("ids", ","))


@query(_SIDES + """
SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.iid, o.iid) AS iid, coalesce(n.intro, o.intro) AS intro
FROM incoming n FULL JOIN existing o ON n.iid = o.iid""")
def keyed_upsert(spark, sf_dir):
    incoming, existing = _sides(spark, sf_dir)
    return upsert.upsert(existing.select("event_id", "iid", "intro"), incoming.select("event_id", "iid", "intro"), seq="event_id")


@query("SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey DESC) AS seq FROM customer")
def appended_order(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey")
    return upsert.new_sequence(c, 1000, "c_custkey", run=700)


@query("""
WITH f AS (SELECT event_id, user_id, event_id // 20 AS page,
  user_id % 4 > 0 AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS fresh FROM events),
p AS (SELECT page, sum(fresh::INTEGER) AS n FROM f GROUP BY page)
SELECT event_id, page FROM f WHERE page <= coalesce((SELECT min(page) FROM p WHERE n = 0), page)""")
def early_stop_pages(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    feed = e.select(F.lit(0).alias("stage"), F.floor(F.col("event_id") / 20).alias("page"), F.col("event_id").alias("pos"), F.col("user_id").alias("iid"))
    known = e.filter("user_id % 4 = 0").select(F.col("user_id").alias("iid")).distinct()
    return sync.until_nothing_new(feed, known).select(F.col("pos").alias("event_id"), "page")


_WANTED = [(3, 42), (1, 7), (2, 42), (5, 11), (4, 99_999_999), (6, 0)]


@query("SELECT pos, doc_id, n_chars FROM documents JOIN (VALUES (2, 42), (1, 7), (5, 11), (6, 0)) v(pos, id) ON doc_id = id")
def ordered_lookup(spark, sf_dir):
    items = spark.createDataFrame(_WANTED, "pos int, doc_id long")
    return library.ordered_lookup(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), items, "doc_id").select("pos", "doc_id", "n_chars")


@query("SELECT min(event_id) AS pos, user_id AS iid FROM events WHERE user_id IN (SELECT doc_id FROM labels) GROUP BY user_id")
def downloaded_in_order(spark, sf_dir):
    items = _read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("iid"))
    return library.downloaded_in_order(items, _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("iid"))).select("pos", "iid")


@query("SELECT DISTINCT 'f' || doc_id AS filename FROM (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id FROM labels)")
def not_found_union(spark, sf_dir):
    _, have, missing = _files(spark, sf_dir)
    return library.add_missing(missing, have)[0]


@query("SELECT count(DISTINCT doc_id) AS gained FROM labels WHERE doc_id % 7 <> 0")
def not_found_gain(spark, sf_dir):
    _, have, missing = _files(spark, sf_dir)
    return library.add_missing(missing, have)[1]


@query("SELECT 0 AS part, event_id AS pos, user_id AS iid FROM events WHERE event_type = 'click' UNION ALL SELECT 1, doc_id, doc_id FROM labels")
def chained_lists(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("pos"), F.col("user_id").alias("iid"))
    return library.chain(e, _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("iid")))


@query("""
SELECT count(*) AS n_records, sum(len(string_split(text, chr(10)))) ::BIGINT AS n_pages, sum((n_chars < 100)::INTEGER)::BIGINT AS n_deleted,
  sum(strlen(text))::BIGINT AS title_bytes, count(DISTINCT lang) AS n_users, count(DISTINCT source) AS n_names FROM documents""")
def distinct_stats(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return stats.collection_stats(d.select(F.split("text", "\n").alias("pages"), (F.col("n_chars") < 100).alias("deleted"), F.col("text").alias("title"), F.col("lang").alias("user_id"), F.col("source").alias("user_name")))


@query("""
SELECT count(DISTINCT w) AS n_tags, sum(strlen(w))::BIGINT AS tag_bytes FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)""")
def tag_stats(spark, sf_dir):
    return stats.tag_stats(_read(spark, sf_dir, "documents").select(F.split("text", " ").alias("tags")))


@query("""
SELECT count(*) AS n, sum((event_type = 'click')::INTEGER)::BIGINT AS failed, sum(CASE WHEN event_type <> 'click' THEN user_id ELSE 0 END)::BIGINT AS bytes FROM events""")
def download_totals(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select((F.col("event_type") != "click").alias("ok"), F.col("user_id").alias("size"))
    return stats.download_totals(e, 2.0).select("n", "failed", "bytes")


@query("SELECT page_id, list_last(string_split(url, '/')) AS filename FROM pages")
def url_filename(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", fn.file_name(F.col("url")).alias("filename"))


@query("SELECT page_id, replace(list_last(string_split(url, '/')), '.', '_') || '_3x.png' AS name FROM pages")
def upscaled_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", fn.upscaled_name(fn.file_name(F.col("url")), 3).alias("name"))


@query("SELECT event_id, CASE WHEN value / 20 <= 2 THEN 2 WHEN value / 20 <= 3 THEN 3 ELSE 4 END AS bucket FROM events")
def ratio_bucket(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", fn.ratio_bucket(F.col("value") / 20).alias("bucket"))


@query("SELECT doc_id, (quality >> 1) + toxic AS rating FROM labels")
def display_rating(spark, sf_dir):
    return _read(spark, sf_dir, "labels").select("doc_id", fn.display_rating(F.col("quality"), F.col("toxic")).alias("rating"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark, sf_dir):
    parsed = F.from_json("props", "k BIGINT", {"mode": "FAILFAST"})
    return _read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 77")
def point_lookup(spark, sf_dir):
    return _read(spark, sf_dir, "events").filter(F.col("event_id") == 77).select("event_id", "user_id", "event_type")
