"""Personal data: base kinds by pattern, then information-theoretic sanitisation. DataFrame functions only.

Base spans (email, ip, card, phone) are regular expressions with checks; a span's place follows from the lengths of
the pieces between matches. Protected entities are the values found, those of their parts that recur (the local part
and the domain of an email, the first three numbers of an ip; digits only for cards and phones), and secrets. All
probabilities are over the n distinct lines of the corpus, so copies count once; lines with an entity that are
near-copies of each other count as one context: contexts are the inverse Simpson index over minhashes of the lines'
terms (``SIGNATURES`` of them, averaged), which no number of variants of one line moves far from 1.

- A term t discloses entity e if they meet in two lines at least, the pointwise mutual information
  log2(n_te n / (n_t n_e)) reaches ``ALPHA`` of e's information log2(n / n_e), and the evidence, contexts of (t, e) times
  that mutual information, reaches log2(entities x terms) + ``MARGIN`` bits: a significance test against all pairs that
  could have met by chance. Every occurrence of t in a document with e is a span: ``removed`` if half of t's lines hold
  e, else ``general``.
- An opaque term (``OPAQUE``, with ``SWITCHES`` changes between letters and digits) stands in no language model, so what
  it tells is what the corpus leaves open: log2(n / contexts of t). It is a ``secret`` if that reaches ``SECRET`` of log2(n),
  the most any term can tell; identifiers that many different lines use aren't.

Counting is by shuffles with partial sums; only lines with an entity or an opaque term are grouped whole. Pairs are only
made of entities that stand in two lines or more: the lines of these are found first. A term's total over the corpus is
counted for the terms that are tested, by a broadcast only while they are few.

Defined cases: null and empty texts have no spans; equal rows keep a row each; a null doc_id is an ordinary value;
an empty table gives an empty result; other columns are kept by ``sanitised`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonloom.session import cut

#: Patterns in possessive form: equal to the plain ones, but in linear time and without deep recursion on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "removed", "general", "secret"]
#: Shares of an entity's information, and of the largest possible information, that count as disclosure.
ALPHA, SECRET = 0.8, 0.5
#: Bits of evidence beyond the number of pairs that could have met, and minhashes of a line.
MARGIN, SIGNATURES = 4.0, 4
#: Terms (or terms of texts, when they are applied) up to which they are broadcast; terms are words of this length at most.
BROADCAST_TERMS = 20_000
TERM = r"[\p{L}\p{N}]+"
#: Keys, tokens and hashes: long runs that mix letters and digits.
OPAQUE, SWITCH, SWITCHES = "[A-Za-z0-9+/_=-]{16,}", "[A-Za-z][0-9]|[0-9][A-Za-z]", 4
#: What a line with an entity or an opaque term matches.
LINES = r"text like '%@%' or text rlike '[0-9][ .()-]{0,2}[0-9]' or text rlike '[A-Za-z0-9+/_=-]{16}'"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _places(text: str, pattern: str, kind: str) -> Column:
    """All matches as structs (start, kind number, end, value), unchecked."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"), x["m"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("gap")))
    return F.aggregate(pairs, none, step, lambda acc: acc["out"])


def _spans(text: str, kind: str) -> Column:
    """Checked spans of a kind; texts without its mark aren't searched."""
    mark = {"email": F.col(text).contains("@"), "ip": F.col(text).rlike(r"[0-9]\.[0-9]"), "card": F.col(text).rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": F.col(text).rlike(r"\+[0-9]")}[kind]
    empty = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    return F.when(mark, F.filter(_places(text, PATTERNS[kind], kind), lambda x: _passes(kind, x["v"]))).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null: empty) and ``_base``, the spans by start and kind."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    return rows.withColumn("_base", F.array_sort(F.concat(*(_spans("_text", k) for k in PATTERNS))))


def _opaque(text: str) -> Column:
    """The opaque terms of a text as structs (start, kind number, end, value)."""
    found = F.filter(_places(text, OPAQUE, "secret"), lambda x: F.size(F.regexp_extract_all(x["v"], F.lit(SWITCH), F.lit(0))) >= SWITCHES)
    return F.when(F.col(text).rlike("[A-Za-z0-9+/_=-]{16}"), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))


def _entities(spans: str) -> Column:
    """The protected entities of base spans: the value and the parts that recur, each (kind number, value)."""

    def of(x: Column) -> Column:
        kind, v = x["k"], F.lower(x["v"])
        name = lambda k, value: F.struct(F.lit(k).alias("k"), value.alias("v"))
        email = F.array(name(0, v), name(10, F.substring_index(v, "@", 1)), name(11, F.substring_index(v, "@", -1)))
        ip = F.array(name(1, v), name(12, F.substring_index(v, ".", 3)))
        return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, F.array(name(2, _digits(v)))).otherwise(F.array(name(3, _digits(v))))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def _line() -> list[Column]:
    """A line's identity: a hash and its length."""
    return [F.xxhash64("text").alias("line"), F.length("text").alias("size")]


def _contexts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contexts): the inverse Simpson index over the minhashes (``signs``) of the keys' rows."""
    each = rows.select(*keys, F.posexplode("signs").alias("j", "sign")).groupBy(*keys, "j", "sign").agg(F.count("*").alias("m"))
    met = each.groupBy(*keys, "j").agg((F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("same"))
    return met.groupBy(*keys).agg((1 / F.avg("same")).alias("contexts"))


def _signs(terms: Column) -> Column:
    def least(j: int) -> Column:  # a function of one parameter: a second one would be the place in the array
        return F.array_min(F.transform(terms, lambda t: F.md5(F.concat(F.lit(f"{j}:"), t))))

    return F.array(*map(least, range(SIGNATURES)))


def evidence(docs: DataFrame) -> tuple[DataFrame, float]:
    """The distinct lines with an entity or an opaque term, and the number of all distinct lines. A line has its terms
    without the entities in it, and their minhashes."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    some = base_spans(lines.where(LINES)).withColumn("_opaque", _opaque("_text")).where("size(_base) > 0 or size(_opaque) > 0")
    some = some.groupBy(*_line()).agg(*(F.first(c).alias(c) for c in ("_text", "_base", "_opaque")))
    bare = F.aggregate(F.concat("_base", "_opaque"), F.col("_text"), lambda t, x: F.replace(t, x["v"], F.lit(" ")))
    words = F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))
    held = some.select("line", "size", "_base", "_opaque", words.alias("words"))
    held = held.select("line", "size", _entities("_base").alias("entities"), F.array_distinct(F.transform("_opaque", lambda x: x["v"])).alias("opaque"), "words", _signs(F.col("words")).alias("signs"))
    n = float(lines.select(*_line()).distinct().count())
    return cut(held), n


def secrets(held: DataFrame, n: float, share: float = SECRET) -> DataFrame:
    """(term): opaque terms that tell at least ``share`` of what a term can."""
    return _contexts(held.select(F.explode("opaque").alias("term"), "signs"), ["term"]).where(F.log2(F.lit(max(n, 1.0)) / F.col("contexts")) >= share * F.log2(F.lit(max(n, 1.0)))).select("term")


def disclosures(docs: DataFrame, alpha: float = ALPHA, margin: float = MARGIN, found: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(entity, term, removed): terms that reveal a protected entity, over the distinct lines of the corpus. An entity
    is its kind's number and its value."""
    held, n = evidence(docs) if found is None else found
    held = held.where("size(entities) > 0")
    n_e = cut(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")))
    # a term's lines among these alone: no more than n_t, so what fails with it fails with n_t
    least = held.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    bits = math.log2(max(n_e.count() * least.count(), 1)) + margin
    mutual = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    tells = (F.col("n_e") < n) & (mutual >= alpha * F.log2(F.lit(n) / F.col("n_e")))
    pairs = _recurring(held, n_e).select("e.entity", "e.n_e", F.explode("words").alias("term"), "signs")
    counts = pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where("n_te > 1")
    met = cut(counts.join(least, "term").where(tells & (F.col("n_te") * mutual >= bits)).drop("n_t"))
    contexts = _contexts(pairs.join(_small(met.select("entity", "term")), ["entity", "term"], "left_semi"), ["entity", "term"])
    met = cut(met.join(contexts, ["entity", "term"]).join(least, "term").where(F.col("contexts") * mutual >= bits).drop("n_t"))
    # as for the entities, copies of a line count once; only wanted terms are moved for that
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    words = lines.select(*_line(), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    wanted = met.select("term").distinct()
    n_t = words.join(_small(wanted), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    found_ = met.join(n_t, "term").where(tells & (F.col("contexts") * mutual >= bits))
    return found_.select("entity", "term", (2 * F.col("n_te") >= F.col("n_t")).alias("removed"))


def _recurring(held: DataFrame, n_e: DataFrame) -> DataFrame:
    """(e, words, signs): a row for each entity of a line, as (entity, n_e), if the entity stands in two lines or more.
    Only such an entity can meet a term twice; most stand in one line, and their words aren't moved."""
    at = held.select("line", "size", F.explode("entities").alias("entity")).join(n_e.where("n_e > 1"), "entity")
    of_line = at.groupBy("line", "size").agg(F.collect_list(F.struct("entity", "n_e")).alias("met"))
    return cut(held.select("line", "size", "words", "signs").join(of_line, ["line", "size"]).drop("line", "size")).select(F.explode("met").alias("e"), "words", "signs")


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (with a string ``term``), to be broadcast if they are proven few and short."""
    n, size = rows.limit(BROADCAST_TERMS + 1).agg(F.count("*"), F.sum(F.length("term"))).first()
    return F.broadcast(rows) if n <= BROADCAST_TERMS and (size or 0) <= 100 * BROADCAST_TERMS else rows


def spans(docs: DataFrame, alpha: float = ALPHA, margin: float = MARGIN, share: float = SECRET) -> DataFrame:
    """``docs`` with ``_text``, ``_base`` and ``_all``: base spans, secrets and those of disclosing terms, by start and
    kind. Added spans don't touch base ones."""
    held, n = evidence(docs)
    hidden, found = cut(secrets(held, n, share)), cut(disclosures(docs, alpha, margin, (held, n)))
    rows = base_spans(docs).withColumn("_opaque", _opaque("_text"))
    key = F.struct(F.coalesce(F.xxhash64("_text"), F.lit(0)).alias("a"), F.length("_text").alias("b"))
    small = lambda x: F.broadcast(x) if x.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else x
    no_text = F.lit(None).cast("string")
    bare = docs.select(F.coalesce("text", F.lit("")).alias("_text"))
    # each of the two searches the texts only for what it needs
    kept = bare.select(key.alias("_key"), F.explode(F.transform(_opaque("_text"), lambda x: x["v"])).alias("secret")).distinct().join(small(hidden.withColumnRenamed("term", "secret")), "secret").select("_key", no_text.alias("gone"), no_text.alias("term"), "secret")
    told = kept.where("false")
    if not found.isEmpty():
        with_base = base_spans(bare.withColumnRenamed("_text", "text")).where("size(_base) > 0")
        told = with_base.select(key.alias("_key"), F.explode(_entities("_base")).alias("entity")).distinct().join(small(found), "entity").select("_key", F.when(F.col("removed"), F.col("term")).alias("gone"), "term", no_text.alias("secret"))
    terms = cut(told.unionByName(kept).groupBy("_key").agg(F.collect_set("gone").alias("_gone"), F.collect_set("term").alias("_terms"), F.collect_set("secret").alias("_secrets")))
    size = terms.agg(F.sum(F.size("_terms") + F.size("_secrets"))).first()[0] or 0
    joined = rows.withColumn("_key", key).join(F.broadcast(terms) if size <= BROADCAST_TERMS else terms, "_key", "left")
    apart = lambda column, x: ~F.exists(column, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    opaque = F.filter("_opaque", lambda x: F.array_contains("_secrets", x["v"]) & apart("_base", x))
    with_secrets = joined.withColumn("_opaque", F.when(F.size("_secrets") > 0, opaque).otherwise(empty))
    places = F.transform(_places("_text", TERM, "general"), lambda x: x.withField("k", F.when(F.array_contains("_gone", F.lower(x["v"])), KINDS.index("removed")).otherwise(x["k"])))
    extra = F.filter(places, lambda x: F.array_contains("_terms", F.lower(x["v"])) & apart("_base", x) & apart("_opaque", x))
    all_spans = F.array_sort(F.concat("_base", "_opaque", F.when(F.size("_terms") > 0, extra).otherwise(empty)))
    return with_secrets.withColumn("_all", all_spans).drop("_key", "_gone", "_terms", "_secrets", "_opaque")


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda x: x["k"] == kind)).cast("bigint")


def joined(column: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def found(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (as text) and n_spans of every row."""
    rows = spans(docs.select("doc_id", "text"), **settings)
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans"), F.size("_all").cast("bigint").alias("n_spans"))


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every base span of the text replaced by its kind in angle brackets, secrets by ``<secret>``,
    disclosing terms removed or replaced by ``<general>``; other columns as they were."""
    # the other columns travel as one struct, so that their names can't clash with those made here
    rows = spans(docs.select("text", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_doc")), **settings)
    marks = F.array(*(F.lit("" if k == "removed" else f"<{k}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # of overlapping spans the first wins its start, later ones only reach on
        gap = F.substr(F.col("_text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        mark = F.when(x["e"] > acc["at"], F.get(marks, x["k"])).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    clean = F.aggregate("_all", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1)))
    text = F.when(F.col("text").isNull() | (F.size("_all") == 0), F.col("text")).otherwise(clean)
    return rows.select(*(text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns))


def found_sql(alpha: float = ALPHA, margin: float = MARGIN, share: float = SECRET) -> str:
    """``found`` in DuckDB's SQL, with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: (case when i % 2 = 1 then (2 * substr(reverse({digits}), i + 1, 1)::int) // 10 + (2 * substr(reverse({digits}), i + 1, 1)::int) % 10 else substr(reverse({digits}), i + 1, 1)::int end))) % 10 = 0"
    checks = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: x::hugeint <= 255))",
        "card": f"length({digits}) between 14 and 19 and {luhn}",
        "phone": f"length({digits}) between 10 and 15",
    }

    def places(source: str, key: str, column: str, pattern: str) -> str:
        """(key, s, e, v): matches with their places, from the lengths of the pieces between."""
        m, gaps = f"regexp_extract_all({column}, '{pattern}')", f"string_split_regex({column}, '{pattern}')"
        inner = f"select {key}, unnest(range(len({m}))) as n, unnest({m}) as v, {m} as ms, {gaps} as gs from {source} where len({m}) > 0"
        s = "coalesce(list_sum(list_transform(gs[1:n + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:n], lambda x: length(x))), 0)"
        return f"select {key}, ({s})::int as s, ({s})::int + length(v) as e, v from ({inner})"

    def base(source: str, key: str) -> str:
        return " union all ".join(f"select {key}, {i} as k, s, e, v from ({places(source, key, 't', p)}) where {checks[name]}" for i, (name, p) in enumerate(plain.items()))

    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' order by s, k)"
    counts = ", ".join(f"count(*) filter (k = {i}) as n_{k}" for i, k in enumerate(PATTERNS))
    term = r"[\p{L}\p{N}]+"
    is_opaque = f"len(regexp_extract_all(v, '{SWITCH}')) >= {SWITCHES}"
    words = f"list_distinct(regexp_extract_all(lower(list_reduce(list_prepend(t, vs), lambda a, x: replace(a, x, ' '))), '{term}'))"
    signs = ", ".join(f"list_min(list_transform(words, lambda x: md5('{j}:' || x)))" for j in range(SIGNATURES))
    parts = {0: "lower(v)", 10: "split_part(lower(v), '@', 1)", 11: "split_part(lower(v), '@', 2)", 1: "v", 12: r"regexp_extract(v, '^([0-9]+\.[0-9]+\.[0-9]+)', 1)", 2: digits, 3: digits}

    def entities(source: str, key: str) -> str:
        of = {10: 0, 11: 0, 12: 1}
        return " union ".join(f"select {key}, {k} as ek, {v} as ev from {source} where k = {of.get(k, k)}" for k, v in parts.items())

    def contexts(source: str, keys: str) -> str:
        """As _contexts; ``source`` has the keys and the lines (key ``line``)."""
        each = f"select {keys}, j, sign, count(*) as m from (select {keys}, j, signs[j] as sign from {source} join words_of using (line), (select unnest(range(1, {SIGNATURES + 1})) as j)) group by all"
        return f"select {keys}, 1 / avg(same) as contexts from (select {keys}, j, sum(m * m) / (sum(m) * sum(m)) as same from ({each}) group by all) group by all"

    return f"""
with docs as (select doc_id, row_number() over () as row_no, coalesce(text, '') as t from documents),
spans as materialized ({base("docs", "row_no")}),
dark as materialized (select row_no, {KINDS.index("secret")} as k, s, e, v from ({places("docs", "row_no", "t", OPAQUE)}) where {is_opaque}),
lines as materialized (select row_number() over () as line, t from (select distinct unnest(string_split(t, chr(10))) as t from docs)),
total as (select count(*)::double as n from lines),
ln as materialized (select * from lines where contains(t, '@') or regexp_matches(t, '[0-9][ .()-]{{0,2}}[0-9]') or regexp_matches(t, '[A-Za-z0-9+/_=-]{{16}}')),
held as materialized ({base("ln", "line")}),
opaque as materialized (select line, s, v from ({places("ln", "line", "t", OPAQUE)}) where {is_opaque}),
gone as (select line, list(v order by o, s, k) as vs from (select line, 0 as o, s, k, v from held union all select line, 1, s, 0, v from opaque) group by line),
words_of as materialized (select line, words, [{signs}] as signs from (select line, {words} as words from gone join ln using (line))),
ents as materialized ({entities("held", "line")}),
n_e as materialized (select ek, ev, count(*) as n_e from ents group by all),
pairs as materialized (select ek, ev, line, unnest(words) as term from ents join words_of using (line)),
tested as (select (select count(*) from n_e)::double * (select count(distinct term) from pairs) as tests),
met as materialized (select ek, ev, term, count(*) as n_te, any_value(n_e) as n_e from pairs join n_e using (ek, ev) group by all having count(*) > 1),
shared as ({contexts("(select pairs.* from pairs semi join met using (ek, ev, term))", "ek, ev, term")}),
n_t as (select term, count(*) as n_t from (select unnest(list_distinct(regexp_extract_all(lower(t), '{term}'))) as term from lines) where term in (select term from met) group by term),
found as (select ek, ev, term, 2 * n_te >= n_t as removed from met join shared using (ek, ev, term) join n_t using (term), total, tested
    where n_e < n and log2(n_te * n / (n_t * n_e)) >= {alpha} * log2(n / n_e) and contexts * log2(n_te * n / (n_t * n_e)) >= log2(greatest(tests, 1)) + {margin}),
secret as (select term from ({contexts("(select distinct v as term, line from opaque)", "term")}), total where log2(n / contexts) >= {share} * log2(n)),
dark_spans as (select * from dark where v in (select term from secret) and not exists (select 1 from spans x where x.row_no = dark.row_no and x.s < dark.e and dark.s < x.e)),
hide as (select row_no, term, bool_or(removed) as removed from ({entities("spans", "row_no")}) join found using (ek, ev) group by all),
hits as (select row_no, s, e, v from ({places("(select * from docs where row_no in (select row_no from hide))", "row_no", "t", term)})),
extra as (select hits.row_no, case when removed then 4 else 5 end as k, hits.s, hits.e from hits join hide on hits.row_no = hide.row_no and lower(hits.v) = hide.term
    where not exists (select 1 from spans x where x.row_no = hits.row_no and x.s < hits.e and hits.s < x.e) and not exists (select 1 from dark_spans x where x.row_no = hits.row_no and x.s < hits.e and hits.s < x.e)),
b as (select row_no, {counts}, {listed} as base from spans group by row_no),
a as (select row_no, {listed} as listed, count(*) as n_spans from (select row_no, k, s, e from spans union all select row_no, k, s, e from dark_spans union all select row_no, k, s, e from extra) group by row_no)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in PATTERNS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(listed, '') as spans, coalesce(n_spans, 0) as n_spans
from docs left join b using (row_no) left join a using (row_no)"""
