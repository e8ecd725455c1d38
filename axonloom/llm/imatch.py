"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions.

Terms are words in lower case. The lexicon keeps those within a band of inverse document frequency: seen in two documents
or more, and in at most one of ``SHARE``. A lexicon subset (level, group) holds a random 1 / (GROUPS * 2^level) of the
terms, chosen by their checksum; a text's entry for a subset is a hash of its sorted distinct terms in it, and changes
only if one of those does. A subset says most if it holds about one term of the text, so a text uses the ``LEVELS`` levels
that begin where it has at most ``PER_LEVEL`` terms in all groups together; its fingerprint lists the entries of subsets
that hold any. The likeness of two fingerprints is the Dice share of entries they have in common, over the levels both
use. A text without a term of the lexicon takes its subsets from all its terms, one without terms an entry of its own.

Document frequencies count every text, but a text that makes up more than one of ``SHARE`` * 100 of all rows counts once:
there are fewer such texts than that, so their keys are broadcast. So are terms beyond the band's common end, at most
``SHARE`` times the mean number of terms a document has, after a check of their number and length; terms within the band
are looked up by a join in which no term has more than 1 / ``SHARE`` of the documents.

Following documents (``with_next``): ranges of ids between quantiles, cut into even parts of about ``BUCKET_ROWS`` rows,
are sorted each in its own task; the first row of a range also goes to the range before as the next of its last row.

Defined cases: null texts are empty; an empty text has the entry of the empty text; equal texts have equal fingerprints;
null ids come last in descending order, by text hash, as repeated ids do among themselves; a table of one row has itself
as the next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.session import cut

#: A term of the lexicon is in two documents or more, and in at most one of this many.
SHARE = 50
#: Groups of a level, terms that the first level used may hold, and levels used.
GROUPS, PER_LEVEL, LEVELS = 32, 32, 3
TERM = r"[\p{L}\p{N}]+"
#: Rows of a range of ids, quantiles of the ids, and rows and characters up to which a list is broadcast.
BUCKET_ROWS, QUANTILES, BROADCAST_ROWS, BROADCAST_CHARS = 3_000, 256, 100_000, 4_000_000


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))


def lexicon(docs: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(band, common): terms (``term``) within the band, and those in more documents than it allows."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    key = F.xxhash64("text")
    total = texts.count()
    heavy = cut(texts.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") * share * 100 > total).select("key"))
    once = texts.join(F.broadcast(heavy), key == F.col("key")).groupBy("key").agg(F.min("text").alias("text")).select("text")
    counted = texts.join(F.broadcast(heavy), key == F.col("key"), "left_anti").unionByName(once)
    n = counted.select(F.count("*")).first()[0]
    df = cut(counted.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1"))
    return df.where(F.col("df") * share <= n).select("term"), df.where(F.col("df") * share > n).select("term")


def first_level(n: Column) -> Column:
    """Smallest level at which ``n`` terms are expected to leave at most ``PER_LEVEL``."""
    over = F.floor((n - 1) / PER_LEVEL)
    return F.when(over > 0, F.length(F.bin(over))).otherwise(0).cast("int")


def _draw(term: Column) -> Column:
    """27 bits of the checksum of a term besides those of its group."""
    return F.floor(F.crc32(term) / GROUPS)


def _sampled(words: str, level: str) -> Column:
    """The terms of a text that its levels look at."""
    return F.filter(words, lambda t: _draw(t) % F.pow(F.lit(2), F.col(level)).cast("bigint") == 0)


def entries(found: Column, level: Column, text: Column) -> Column:
    """Level, group and hash of each subset with a term among ``found``; a digest of ``text`` if there is none."""
    each = F.array_sort(F.transform(found, lambda t: F.struct(t.alias("t"), (F.crc32(t) % GROUPS).alias("g"), _draw(t).alias("d"))))
    levels = F.sequence(level, level + LEVELS - 1)

    def of_level(x: Column) -> Column:
        inside = F.filter(each, lambda y: y["d"] % F.pow(F.lit(2), x).cast("bigint") == 0)
        groups = F.array_distinct(F.transform(inside, lambda y: y["g"]))
        held = lambda g: F.array_join(F.transform(F.filter(inside, lambda y: y["g"] == g), lambda y: y["t"]), " ")
        return F.transform(groups, lambda g: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lpad(g.cast("string"), 2, "0"), F.substring(F.md5(held(g)), 1, 6)))

    return F.when(F.size(found) > 0, F.array_sort(F.flatten(F.transform(levels, of_level)))).otherwise(F.array(F.concat(F.lit("~"), F.md5(text))))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the entries of two fingerprints (strings) on levels that both use; 1 for equal ones."""
    lowest = F.greatest(F.substring(a, 1, 2), F.substring(b, 1, 2))
    x, y = (F.filter(F.split(s, ","), lambda e: e >= lowest) for s in (a, b))
    size = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(size > 0, 2.0 * F.size(F.array_intersect(x, y)) / size).otherwise(0.0)


def _few(rows: DataFrame) -> DataFrame:
    n, chars = rows.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.length("term"))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS else rows


def _in_band(rows: DataFrame, candidates: str, docs: DataFrame) -> DataFrame:
    """(key, band): terms of the lexicon among the array ``candidates`` of each ``key``."""
    band, common = lexicon(docs)
    each = rows.select("key", F.explode(candidates).alias("term"))
    each = each.join(_few(common), "term", "left_anti").join(band, "term", "left_semi")
    return each.groupBy("key").agg(F.collect_set("term").alias("band"))


def _print(words: str, level: str, text_md5: str) -> Column:
    kept = F.array_intersect(words, F.coalesce("band", F.array().cast("array<string>")))
    return F.array_join(entries(F.when(F.size(kept) > 0, kept).otherwise(F.col(words)), F.col(level), F.col(text_md5)), ",")


def fingerprints(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fingerprint of every row of ``texts``, by the lexicon of ``docs``."""
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.md5("text").alias("digest"), terms(F.col("text")).alias("words"))
    rows = rows.withColumn("level", first_level(F.size("words"))).select("*", _sampled("words", "level").alias("some"), F.xxhash64("doc_id", "text_key").alias("key"))
    rows = cut(rows.drop("words"))
    found = rows.join(_in_band(rows, "some", docs), "key", "left")
    return found.select("doc_id", "text_key", _print("some", "level", "digest").alias("fingerprint"))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, next_id and next_text of every row: the row that follows by descending doc_id; the first follows the
    last. Null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, most, least = rows.agg(F.count("*"), F.max("doc_id"), F.min("doc_id")).first()
    wanted = max(1, -(-total // bucket_rows))
    ranges = min(QUANTILES, wanted)
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    edges = sorted({least, *found, most + 1}) if most is not None else [0, 1]
    parts = -(-wanted // ranges)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col("doc_id"))) - 1
    low, high = (F.get(F.array(*(F.lit(float(x)) for x in edges)), F.col("_at") + i) for i in (0, 1))
    inside = F.least(F.floor((F.col("doc_id").cast("double") - low) / (high - low) * parts), F.lit(parts - 1))
    # without an id, by hash: buckets below all others
    bucket = F.coalesce(F.col("_at") * parts + inside, F.shiftright("text_key", 54) - 513).cast("bigint")
    rows = rows.withColumns({"text_key": F.xxhash64("text"), "_at": at}).withColumn("bucket", bucket).drop("_at")
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key").desc()]
    down = W.orderBy(F.col("bucket").desc())
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_key")).alias("head"))
    heads = cut(heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(W.partitionBy())).alias("to")))
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    first = F.col("head").eqNullSafe(F.struct("doc_id", "text_key"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    places = F.when(first, F.array(own, F.struct(F.col("to").alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = rows.join(heads, "bucket").select("doc_id", "text", "text_key", F.explode(places).alias("place")).select("*", "place.b", "place.guest").drop("place")
    after = W.partitionBy("b").orderBy("guest", *order)
    nexts = dealt.select("doc_id", "text", "guest", F.lead("doc_id").over(after).alias("next_id"), F.lead("text").over(after).alias("next_text"))
    return nexts.where("not guest").drop("guest")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row: each text
    against itself with its last third replaced by the next text's beginning, and against the next text."""
    n = F.length("text")
    rows = with_next(docs).select("*", n.cast("bigint").alias("n_chars"), F.floor(n / 3).cast("int").alias("_k"))
    changed = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_k")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("_k")))
    rows = rows.withColumn("changed", changed)
    rows = rows.select(
        "doc_id", "next_id", "n_chars", F.xxhash64("text").alias("text_key"), F.xxhash64("next_text").alias("next_key"), F.xxhash64("doc_id", "text", "next_text").alias("key"), F.sha2("changed", 256).alias("edited_sha256"),
        F.md5("text").alias("digest"), F.md5("changed").alias("changed_digest"), terms(F.col("text")).alias("words"), terms(F.col("changed")).alias("changed_words"),
    )
    rows = rows.withColumns({"level": first_level(F.size("words")), "changed_level": first_level(F.size("changed_words"))})
    rows = rows.withColumns({"words": _sampled("words", "level"), "changed_words": _sampled("changed_words", "changed_level")})
    rows = cut(rows)
    both = rows.select("key", F.array_union("words", "changed_words").alias("some"))
    found = rows.join(_in_band(both, "some", docs), "key", "left")
    prints = found.select(
        "doc_id", "next_id", "n_chars", "text_key", "next_key", "edited_sha256",
        _print("words", "level", "digest").alias("fingerprint"), _print("changed_words", "changed_level", "changed_digest").alias("edited_fingerprint"),
    )
    prints = cut(prints)
    nexts = prints.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("fingerprint").alias("_next")).dropDuplicates(["_id", "_key"])
    paired = prints.join(nexts, F.col("next_id").eqNullSafe(F.col("_id")) & (F.col("next_key") == F.col("_key")))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return paired.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("_next").alias("near_next"))


def edited_sql(share: int = SHARE) -> str:
    """``edited`` in DuckDB's SQL, for tables whose ids are unique."""
    from axonloom.llm.sharding import crc32_sql

    like = """case when {a} = {b} then 1.0 when len(list_filter(string_split({a}, ','), lambda e: e >= greatest(left({a}, 2), left({b}, 2)))) + len(list_filter(string_split({b}, ','), lambda e: e >= greatest(left({a}, 2), left({b}, 2)))) = 0 then 0.0
      else 2.0 * len(list_filter(list_intersect(string_split({a}, ','), string_split({b}, ',')), lambda e: e >= greatest(left({a}, 2), left({b}, 2))))
        / (len(list_filter(string_split({a}, ','), lambda e: e >= greatest(left({a}, 2), left({b}, 2)))) + len(list_filter(string_split({b}, ','), lambda e: e >= greatest(left({a}, 2), left({b}, 2))))) end::double"""
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
heavy as (select text from d group by text having count(*) * {share * 100} > (select count(*) from d)),
counted as (select text from d where text not in (select text from heavy) union all select text from heavy),
df as (select term, count(*) as df from (select unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) as term from counted) group by term),
lexicon as (select term from df where df > 1 and df * {share} <= (select count(*) from counted)),
n as (select doc_id, text, length(text) as n, coalesce(lead(doc_id) over (order by doc_id desc), max(doc_id) over ()) as next_id from d),
e as (select n.doc_id, n.next_id, n.n, n.text, substring(n.text, 1, n.n - n.n // 3) || substring(x.text, 1, n.n // 3) as changed from n join d x on x.doc_id = n.next_id),
v as (select doc_id, 0 as v, text from e union all select doc_id, 1, changed from e),
t as (select doc_id, v, text, list_distinct(regexp_extract_all(lower(text), '{TERM}')) as words from v),
l as (select *, case when (len(words) - 1) // {PER_LEVEL} > 0 then length(bin((len(words) - 1) // {PER_LEVEL})) else 0 end as level from t),
u as (select doc_id, v, level, unnest(words) as term from l),
c as (select term, {crc32_sql("term")} as crc, term in (select term from lexicon) as band from (select distinct term from u)),
s as (select doc_id, v, level, term, crc % {GROUPS} as g, crc // {GROUPS} as draw, band, bool_or(band) over (partition by doc_id, v) as any_band
      from u join c using (term) where crc // {GROUPS} % (1::bigint << level) = 0),
k as (select doc_id, v, x, g, substr(md5(string_agg(term, ' ' order by term)), 1, 6) as h
      from (select *, unnest(range(level, level + {LEVELS})) as x from s where band or not any_band) where draw % (1::bigint << x) = 0 group by doc_id, v, x, g),
f as (select doc_id, v, string_agg(lpad(x::varchar, 2, '0') || lpad(g::varchar, 2, '0') || h, ',' order by lpad(x::varchar, 2, '0') || lpad(g::varchar, 2, '0') || h) as f from k group by doc_id, v),
sampled as (select distinct doc_id, v from s),
p as (select v.doc_id, v.v, case when sampled.v is null then '~' || md5(text) else coalesce(f, '') end as f from v left join f using (doc_id, v) left join sampled using (doc_id, v))
select e.doc_id, e.n as n_chars, sha256(changed) as edited_sha256, a.f as fingerprint, b.f as edited_fingerprint, {like.format(a="a.f", b="b.f")} as near_edited, {like.format(a="a.f", b="c.f")} as near_next
from e join p a on a.doc_id = e.doc_id and a.v = 0 join p b on b.doc_id = e.doc_id and b.v = 1 join p c on c.doc_id = e.next_id and c.v = 0"""
