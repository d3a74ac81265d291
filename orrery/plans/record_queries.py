"""Registered queries over records: documents written as JSON records, and what is made of them.

A document's id, source, language and length give its record's fields by the rules of _record() here and
of _RECORDS in SQL; the operators then start from the JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import library, model, pages, upsert, users
from ..sources import records, state
from ..streaming import sync
from .registry import query, read, shared


def _url(name: Column) -> Column:
    return F.concat(F.lit(model.URL_PREFIX + "24/01/"), name)


def _record(name: Column | None = None, title: Column | None = None, caption: Column | None = None) -> Column:
    """One record a document; the user's name has white space around it."""
    doc, n = F.col("doc_id"), F.col("n_chars")
    count = (doc % 3 + 1).cast("int")
    file = lambda i: F.concat(doc.cast("string"), F.lit("_p"), F.lit(i).cast("string") if isinstance(i, int) else i.cast("string"), F.lit(".jpg"))
    single = F.when(doc % 33 == 0, model.LIMITED_URLS[0]).otherwise(_url(file(0)))
    many = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.struct(_url(file(i)).alias("original")).alias("image_urls")))
    return F.to_json(
        F.struct(
            doc.alias("id"), (F.concat("source", F.lit(" "), doc) if title is None else title).alias("title"),
            F.struct((n % 50).cast("string").alias("id"), F.concat(F.lit("　"), F.col("lang") if name is None else name, F.lit(" ")).alias("name"), F.col("lang").alias("account")).alias("user"),
            (n % 900 + 1).alias("width"), (n % 700 + 1).alias("height"), F.struct(F.when(count == 1, single).alias("original_image_url")).alias("meta_single_page"), count.alias("page_count"),
            F.when(count > 1, many).otherwise(F.slice(many, 1, 0)).alias("meta_pages"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias("tags"),
            (doc % 5 * 2).alias("sanity_level"), (doc % 2).alias("x_restrict"), (doc % 13 != 0).alias("visible"), F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0")).alias("create_date"),
            (F.lit("") if caption is None else caption).alias("caption"), F.lit(True).alias("is_bookmarked"), F.lit("illust").alias("type"),
        )
    )


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("iid"), _record().alias("raw"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = model.parse_records(_bronze(spark, sf_dir))
    return users.with_primary(parsed, users.primary_names(parsed))


_RECORDS = f"""
WITH r AS (SELECT doc_id AS iid, source || ' ' || doc_id AS title, n_chars % 50 AS user_id, lang, source,
    (n_chars % 900 + 1)::INTEGER AS width, (n_chars % 700 + 1)::INTEGER AS height, (doc_id % 3 + 1)::INTEGER AS page_count,
    (doc_id % 5 * 2)::INTEGER AS sanity_level, (doc_id % 2)::INTEGER AS x_restrict, doc_id % 13 <> 0 AS visible,
    '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS create_date, doc_id % 33 = 0 AS deleted FROM documents),
names AS (SELECT user_id, lang AS primary_name FROM (
    SELECT user_id, lang, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(iid)) AS k FROM r GROUP BY user_id, lang) WHERE k = 1),
named AS (SELECT r.*, primary_name, CASE WHEN lang = primary_name THEN [lang, source] ELSE [lang, lang, source] END AS tags FROM r JOIN names USING (user_id)),
p AS (SELECT iid, page_count, pn::INTEGER AS pn, CASE WHEN deleted THEN '{model.LIMITED_URLS[0]}' ELSE '{model.URL_PREFIX}24/01/' || iid || '_p' || pn || '.jpg' END AS url,
    CASE WHEN deleted THEN 'limit_unknown_360.png' ELSE iid || '_p' || pn || '.jpg' END AS filename, width, height
    FROM r, unnest(range(page_count)) AS u(pn))"""


@query(_RECORDS + """
SELECT iid, title, user_id, lang AS user_name, width, height, page_count, lang || ',' || source AS tags, sanity_level, x_restrict, visible, create_date, deleted FROM r""")
def record_fields(spark, sf_dir):
    return model.parse_records(_bronze(spark, sf_dir)).drop("seq", "pages").withColumn("tags", F.array_join("tags", ","))


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("width", "height")})


@query(_RECORDS + "SELECT iid, pn, url, filename, CASE WHEN pn = 0 THEN width ELSE -1 END AS width, CASE WHEN pn = 0 THEN height ELSE -1 END AS height FROM p")
def page_rows(spark, sf_dir):
    return _sized(pages.exploded(model.parse_records(_bronze(spark, sf_dir))))


@query(_RECORDS + r"""
SELECT iid, lower(replace(title, ' ', '')) || '\' || primary_name || '\' || array_to_string(tags, '\')
  || '\$s' || sanity_level || '\$x' || x_restrict || '\$r' || (x_restrict + sanity_level // 2)
  || CASE WHEN sanity_level <> 2 THEN '\$n' ELSE '' END || CASE WHEN sanity_level >= 6 THEN '\$h' ELSE '' END
  || CASE WHEN width >= height THEN '\$w' ELSE '' END || CASE WHEN width >= height OR page_count > 1 THEN '\$l' ELSE '' END
  || CASE WHEN width <= height THEN '\$t' ELSE '' END AS intro FROM named""")
def record_intro(spark, sf_dir):
    return sync.with_intros(_bronze(spark, sf_dir)).select("iid", "intro")


_PAGES = "(SELECT string_agg({0}, '{1}' ORDER BY pn) FROM p WHERE p.iid = named.iid)"


@query(_RECORDS + f"""
SELECT iid AS id, title, user_id, primary_name AS user_name, array_to_string(tags, ',') AS tags, create_date, (sanity_level >> 1) + x_restrict AS rating,
  {_PAGES.format("p.width || 'x' || p.height || ':' || p.filename", " ")} AS pages FROM named""")
def search_result(spark, sf_dir):
    page = lambda p: F.concat(p["w"].cast("string"), F.lit("x"), p["h"].cast("string"), F.lit(":"), p["filename"])
    return pages.projected(_named(spark, sf_dir)).withColumns({"tags": F.array_join("tags", ","), "pages": F.array_join(F.transform("pages", page), " ")})


@query(_RECORDS + f"""
SELECT iid AS id, '[' || iid || ',"' || title || '",' || user_id || ',"' || primary_name || '",["' || array_to_string(tags, '","') || '"],['
  || {_PAGES.format("""'[' || p.width || ',' || p.height || ',"img","' || p.filename || '"]'""", ",")}
  || '],"' || create_date || '",' || ((sanity_level >> 1) + x_restrict) || ']' AS json FROM named""")
def wire_rows(spark, sf_dir):
    return pages.wire(pages.projected(_named(spark, sf_dir)))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every other document's further pages, saved and loaded again; some are of a wrong length."""
    doc = F.col("doc_id")
    four = F.array(*((doc % 100 + k).cast("int") for k in range(1, 5)))
    sizes = F.when(doc % 10 == 0, F.array(F.lit(7))).otherwise(F.slice(four, F.lit(1), (doc % 3 * 2).cast("int")))
    path = shared(spark, "state")
    state.save(read(spark, sf_dir, "documents").filter(doc % 2 == 0).select(doc.alias("iid"), sizes.alias("sizes")), path, "dims")
    return state.load(spark, path, "dims")


_KNOWN = "iid % 2 = 0 AND iid % 10 <> 0"


@query(_RECORDS + f"""
SELECT iid, pn, url, filename, CASE WHEN pn = 0 THEN width WHEN {_KNOWN} THEN (2 * pn - 1 + iid % 100)::INTEGER ELSE -1 END AS width,
  CASE WHEN pn = 0 THEN height WHEN {_KNOWN} THEN (2 * pn + iid % 100)::INTEGER ELSE -1 END AS height FROM p""")
def dims_applied(spark, sf_dir):
    return _sized(pages.exploded(pages.apply_dimensions(model.parse_records(_bronze(spark, sf_dir)), _dims(spark, sf_dir))))


@query(_RECORDS + f"""
SELECT iid, string_agg((2 * pn - 1 + iid % 100) || ',' || (2 * pn + iid % 100), ',' ORDER BY pn) AS sizes FROM p WHERE pn > 0 AND {_KNOWN} GROUP BY iid""")
def dims_dumped(spark, sf_dir):
    sized = pages.apply_dimensions(model.parse_records(_bronze(spark, sf_dir)), _dims(spark, sf_dir))
    return pages.dump_dimensions(sized).select("iid", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


@query(_RECORDS + "SELECT iid, pn, url, filename, iid || '_p' || pn || '_jpg_2x.png' AS upscaled FROM p WHERE iid = 41 AND pn = 2")
def page_lookup(spark, sf_dir):
    flat = pages.exploded(model.parse_records(_bronze(spark, sf_dir)))
    missing = flat.filter("iid % 7 = 0").select("filename")
    return pages.lookup(flat, missing, 41, 2, 2).unionByName(pages.lookup(flat, missing, 42, 0, 2))


@query(_RECORDS + "SELECT iid AS seq, iid, title FROM r WHERE iid = 77")
def stored_point(spark, sf_dir):
    path = shared(spark, "bronze")
    records.swap(_bronze(spark, sf_dir), path)
    return records.point(records.read_bronze(spark, path), 77).select("seq", "iid", F.get_json_object("raw", "$.title").alias("title"))


@query("SELECT doc_id AS seq, doc_id AS iid FROM documents")
def read_ids(spark, sf_dir):
    return model.only_ids(_bronze(spark, sf_dir).withColumn("iid", F.lit(None).cast("long"))).select("seq", "iid")


@query("SELECT doc_id AS iid, md5('{' || text || '}') AS raw_md5 FROM documents")
def blob_round_trip(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("iid"), F.concat(F.lit("{"), "text", F.lit("}")).alias("raw"))
    return records.decode_blobs(records.encode_blobs(texts)).select("iid", F.md5("raw").alias("raw_md5"))


@query("SELECT (r_regionkey + 1)::BIGINT AS seq, r_regionkey::BIGINT AS iid, r_name AS name FROM region")
def imported_array(spark, sf_dir):
    rows = read(spark, sf_dir, "region").select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("r"))
    path = shared(spark, "import")
    rows.agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("value")).write.text(path)
    return records.import_json_array(spark, path).select("seq", "iid", F.get_json_object("raw", "$.name").alias("name"))


_SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{_SPACE}', ''), '{_SPACE}$', '')) AS text_md5 FROM documents")
def trimmed_text(spark, sf_dir):
    padded = F.concat(F.lit("　 \t"), "text", F.lit(" \n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fn.trim_white(padded)).alias("text_md5"))


@query("""
SELECT event_id, '-   "k": ' || k || '|+   "k": ' || (k + 1) AS diff FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events) WHERE event_id % 2 = 0""")
def record_diff(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw"), F.to_json(F.struct((k + (F.col("event_id") % 2 == 0).cast("int")).alias("k"))).alias("after"))
    return upsert.json_diff(e.select("event_id", "raw"), e.select("event_id", F.col("after").alias("raw")), "event_id").withColumn("diff", F.array_join("diff", "|"))


@query('SELECT greatest(300000, sum(n)) ::BIGINT AS "limit" FROM (SELECT lang, source, max(n_chars) AS n FROM documents GROUP BY lang, source)')
def automatic_limit(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source").alias("filename"), F.col("n_chars").alias("size"), F.col("doc_id").alias("accessed"))
    return library.automatic_limit(files, 300_000)


def _synced(spark: SparkSession, sf_dir: str) -> tuple[sync.Collection, DataFrame]:
    """Two batches of a feed: first the documents whose id isn't a multiple of 4, then all, some with
    another title and some with another caption."""
    docs = read(spark, sf_dir, "documents")
    doc, name = F.col("doc_id"), F.concat(F.lit("u"), (F.col("n_chars") % 50).cast("string"))
    place = [(doc % 2).cast("int").alias("stage"), F.floor(doc / 20).cast("int").alias("page"), (doc % 20).cast("int").alias("pos")]
    title = F.concat("source", F.lit(" "), doc, F.when(doc % 10 == 3, "!").otherwise(""))
    caption = F.when(doc % 10 == 5, "x").otherwise("")
    held = sync.Collection(spark, shared(spark, "collection"))
    held.apply(docs.filter(doc % 4 > 0).select(*place, _record(name).alias("raw")))
    return held, held.apply(docs.select(*place, _record(name, title, caption).alias("raw")))


@query("""
SELECT doc_id AS iid, CASE WHEN doc_id % 4 = 0 THEN 'New' WHEN doc_id % 13 = 0 THEN 'Hidden' WHEN doc_id % 10 = 3 THEN 'IntroChanged'
  WHEN doc_id % 10 = 5 THEN 'IntroUnchanged' ELSE 'Skipped' END AS status FROM documents""")
def synced_status(spark, sf_dir):
    return _synced(spark, sf_dir)[1].select("iid", "status")


@query("""
SELECT doc_id AS iid, row_number() OVER (ORDER BY doc_id % 4 = 0, doc_id % 2 DESC, doc_id DESC) AS seq FROM documents""")
def synced_order(spark, sf_dir):
    return _synced(spark, sf_dir)[0].stored().select("iid", "seq")


@query("""
SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id) AS pos, doc_id AS iid FROM documents WHERE doc_id % 4 = 0 OR doc_id % 13 > 0 AND doc_id % 10 IN (3, 5)""")
def hook_order(spark, sf_dir):
    """The hook's records, numbered by their place in the feed; here by their rank in it."""
    from pyspark.sql import Window

    put = sync.hooked(_synced(spark, sf_dir)[1])
    below = put.select(F.floor(F.col("pos") / 1024).alias("run"), "pos", "iid")
    sizes = below.groupBy("run").agg(F.count("*").alias("n"))
    before = sizes.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy("pos"))
    return below.withColumn("rank", rank).join(before, "run").select((F.col("before") + F.col("rank")).cast("long").alias("pos"), "iid")


@query("""
SELECT doc_id AS iid FROM documents WHERE contains(lower(source || doc_id || CASE WHEN doc_id % 10 = 3 AND (doc_id % 4 = 0 OR doc_id % 13 > 0) THEN '!' ELSE '' END), '3!')
  AND NOT contains('\\u' || n_chars % 50 || '\\', '\\u7\\')""")
def synced_search(spark, sf_dir):
    return _synced(spark, sf_dir)[0].select(["3!"], ["\\u7\\"]).select("iid")
