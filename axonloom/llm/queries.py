"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonloom.llm import bpe, decontaminate, imatch, language, licenses, periodic, pii, quality_model, quality_rules, sharding, simhash, toxicity, variants
from axonloom.llm.textops import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _held_out(of: int, part: int):
    return F.coalesce(language.held_out(part, of), F.lit(False)).alias("held_out")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(3, 1), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scanned(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_license_paragraphs"), F.array_join(families, ",").alias("licenses"), best.alias("probability"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_model.scored(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(4, 2), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predicted(docs, language.train(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(periodic.planted(table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic.listed_runs(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited(table(spark, sf_dir, "documents"))


def _mistyped(doc_id: bytes, word: bytes) -> bytes:
    """Of every 199th pair of document and word (by its checksum) the word without one letter."""
    h = zlib.crc32(b"%s:%s" % (doc_id, word))
    if h % 199:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.vocabulary(table(spark, sf_dir, "documents"), change=_mistyped))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_toxicity, op3_quality_rules, op4_licenses, op5_pii, op6_bpe, op7_sharding, op8_quality, op9_simhash, op10_language, op11_periodic, op12_imatch, op13_variants)
}

OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hits as (select doc_id, i, dw.k as k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def op3_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))
    tests = []
    for name, low, high in quality_rules.RULES:
        tests += [f"{name} >= {low}"] * (low is not None) + [f"{name} <= {high}"] * (high is not None)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) > 5)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id),
m as (select w.doc_id, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
        len(list_filter(words, lambda x: lower(translate(x, '.,;:!?', '')) in ({stops}))) as n_stop,
        length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) as n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) as n_letters
      from w left join r using (doc_id)),
q as (select *, case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars, case when word_chars > 0 then n_symbols / word_chars else 0 end as symbol_ratio,
        case when n_words > 0 then n_stop / n_words else 0 end as stop_word_ratio, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio,
        case when n_letters > 0 then n_upper / n_letters else 0 end as upper_ratio from m),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(tests)} as kept from f"""


#: Squares with at least 12 words contain six words that return a period later: stretches of such returns are runs.
OP11_SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {sharding.crc32_sql("doc_id::varchar")} as h from documents),
k as (select doc_id, w, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from w),
p as (select doc_id, w, n, a, 1 + (n - a) // (3 + g % 8) as p from k),
d as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) end as w from p),
s as (select doc_id, i, array_to_string(w[i:i + 5], ' ') as g from (select doc_id, w, unnest(range(1, n - 4)) as i from d where n >= 12)),
m as (select x.doc_id, x.i, y.i - x.i as q from s x join s y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i),
r as (select doc_id, min(i) - 1 as start, count(*) + 5 + q as length, q
      from (select doc_id, i, q, i - row_number() over (partition by doc_id, q order by i) as island from m) group by doc_id, q, island),
runs as (select doc_id, start, length, min(q) as period from r where length >= greatest(12, 2 * q) group by doc_id, start, length),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
             arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) as best from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(x, ' ' order by i) as kept from (select doc_id, unnest(w) as x, unnest(range(n)) as i from d) left join gone using (doc_id, i) where gone.doc_id is null group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
       sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join listed using (doc_id) left join kept using (doc_id)"""

OP13_SQL = rf"""
with recursive o as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
c as (select doc_id, w, count(*) as c from o group by doc_id, w),
h as (select w, c, {sharding.crc32_sql("doc_id::varchar || ':' || w")} as h from c),
v as materialized (select word, sum(c)::bigint as n from (select case when h % 199 = 0 then substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) else w end as word, c from h)
      group by word having sum(c) >= {variants.LEAST} and length(word) >= {variants.SHORTEST}),
less as materialized (select word, i, substring(word, 1, i - 1) || substring(word, i + 1) as d from (select word, unnest(range(1, length(word) + 1)) as i from v)),
near as (select a.word as a, b.word as b from less a join v b on a.d = b.word union select b.word, a.word from less a join v b on a.d = b.word
         union select a.word, b.word from less a join less b on a.d = b.d and a.i = b.i and a.word <> b.word),
best as (select a as word, count(*) as n_near, arg_min({{'form': b, 'n': n}}, (-n, b)) as best from near join v on b = word group by a),
f as materialized (select word, n, coalesce(n_near, 0) as n_near, case when best.n >= {variants.RATIO} * n then best.form end as form, case when best.n >= {variants.RATIO} * n then best.n end as form_n from v left join best using (word)),
chain as (select word, form as root from f where form is not null union all select chain.word, f.form from chain join f on chain.root = f.word where f.form is not null),
roots as (select chain.word, root from chain join f on root = f.word where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from f left join roots using (word)"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_quality_rules": op3_sql(), "op5_pii": pii.found_sql(), "op7_sharding": sharding.sharded_sql(40), "op11_periodic": OP11_SQL, "op12_imatch": imatch.edited_sql(), "op13_variants": OP13_SQL}
