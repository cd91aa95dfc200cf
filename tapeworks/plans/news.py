"""Queries over articles, companies, industries and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks, sentiment, text
from ..operators import articles, companies, dedup, lookup, sketches, usage
from ..sources import files, ingest
from . import streamed
from .views import Views, prefix

A = prefix("articles")
NOW = "2024-01-31 00:00:00"
#: The lexicon, and frequent syllables, for the test articles are invented words.
WORDS = sentiment.LEXICON | {"on": 0.5, "er": -0.4, "th": 0.1, "de": 0.3, "qu": -0.6}


def _now():
    return F.lit(NOW).cast("timestamp")


def r(e: str, name: str = "") -> str:
    return f"round(cast({e} as double), 6) + 0.0 as {name or e}"


def scored(v: Views) -> DataFrame:
    """Articles with a compound from their id (spread over -1 to 1) and a time."""
    c = (F.pmod(F.col("article_id") * 7919, F.lit(2001)) - 1000) / 1000.0
    return v.articles.withColumns({"compound": c, "polarity": c * 0.5, "article_timestamp": _now() - F.make_dt_interval(hours=F.pmod(F.col("article_id"), F.lit(400)).cast("int"))})


SCORED = f"{A}, s as (select *, ((article_id * 7919) % 2001 - 1000) / 1000.0::double as compound, ((article_id * 7919) % 2001 - 1000) / 1000.0::double * 0.5::double as polarity, timestamp '{NOW}' - to_hours(cast(article_id % 400 as int)) as tm from articles)"


def _contains(column: str, phrases) -> str:
    q = lambda p: p.replace("'", "''")  # noqa: E731
    return "(" + " or ".join(f"contains({column}, '{q(p)}')" for p in phrases) + ")"


_ARTICLE = "a as (select article_id, symbol, source, url, text, lower(text) as low from articles)"
_CLEAN = r"trim(replace(replace(replace(replace(replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'))".replace('\\"', '"')
_TITLE = "case when contains(text, '.') then split_part(text, '.', 1) else substring(text, 1, 100) end"


def _lexicon_sql() -> str:
    quoted = ((p.replace("'", "''"), w) for p, w in WORDS.items())
    return " + ".join(f"case when contains(low, '{p}') then {w * 0.8!r}::double else 0.0::double end" for p, w in quoted)


def _weighted_sql(groups) -> str:
    return " + ".join(f"case when contains(low, '{t}') then {w!r}::double else 0.0 end" for w, terms in groups for t in terms)


def _either_sql(rule, when: str = "true") -> str:
    w, good, bad = rule
    return f"case when not ({when}) then 0.0 when {_contains('low', good)} then {w!r}::double when {_contains('low', bad)} then {-w!r}::double else 0.0 end"


_BOOST = " + ".join(
    [
        _weighted_sql(sentiment.BOOSTS), _either_sql(sentiment.TRADES), _either_sql(sentiment.EARNINGS, "contains(low, 'earnings')"),
        "case when try_cast(regexp_extract(low, '([0-9]+([.][0-9]+)?)%', 1) as double) > 2 then 0.3 else 0.0 end", _either_sql(sentiment.DOLLARS, "regexp_matches(low, '[$][0-9]+')"),
    ]
)  # fmt: skip
_MODEL_BOOST = _weighted_sql([(sentiment.MODEL_SCALE[w], t) for w, t in sentiment.BOOSTS if w in sentiment.MODEL_SCALE]) + " + " + _either_sql(sentiment.MODEL_DOLLARS, "regexp_matches(low, '[$][0-9]+')")
_TITLE_SCORE = f"""(case when {_contains("t", sentiment.TITLE_STRONG_NEGATIVE)} then -0.7 else 0.0 end + case when {_contains("t", sentiment.TITLE_STRONG_POSITIVE)} then 0.7 else 0.0 end)"""
_TITLE_WEAK = f"""(case when {_contains("t", sentiment.TITLE_NEGATIVE)} then -0.4 else 0.0 end + case when {_contains("t", sentiment.TITLE_POSITIVE)} then 0.4 else 0.0 end)"""
#: The sum of the strong phrases (moderate ones where it is under 0.1), from -0.8 to 0.8.
_TITLE_POLARITY = f"greatest(-0.8, least(0.8, case when abs({_TITLE_SCORE}) >= 0.1 then {_TITLE_SCORE} else {_TITLE_WEAK} end))::double"


def _labelled(v: Views) -> DataFrame:
    """Articles with the label and score that a model might have given them."""
    label = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), (F.pmod(F.col("article_id"), F.lit(3)) + 1).cast("int"))
    return v.articles.withColumns({"label": label, "score": F.pmod(F.col("article_id"), F.lit(100)) / 100.0})


def _calibrated(v: Views) -> DataFrame:
    p, c = sentiment.calibrate(F.col("label"), F.col("score"), F.col("text"))
    return _labelled(v).select("article_id", p.alias("polarity"), c.alias("compound"))


def _combined(v: Views) -> DataFrame:
    p, c = sentiment.combine_lexicon(F.lit(0.05), F.lit(0.5), sentiment.lexicon_score(F.col("text"), WORDS) + sentiment.boost_score(F.col("text")))
    return v.articles.select("article_id", p.alias("polarity"), c.alias("compound"))


def _enriched(v: Views) -> DataFrame:
    """Whole articles with the whole text of the next one as what was extracted."""
    following = v.articles.select((F.col("article_id") - 1).alias("article_id"), F.col("text").alias("extracted"))
    return text.enrich(v.articles.join(following, "article_id", "left"))


_ENRICHED = f"{A}, e as (select a.article_id, a.symbol, a.source, a.text, b.text as extracted from articles a left join articles b on b.article_id = a.article_id + 1), x as (select *, coalesce(length(text), 0) as la, coalesce(length(extracted), 0) as lb from e)"


def _enriched_whole(v: Views) -> DataFrame:
    """Whole articles with the text extracted from the page of their number, null where there is none."""
    found = _pages_text(v).select(F.col("page_id").alias("article_id"), F.col("text").alias("extracted"))
    return text.enrich(v.articles.join(found, "article_id", "left"))


def _pages_text(v: Views) -> DataFrame:
    """page_id and the text that extraction finds."""
    return v.table("pages").select("page_id", "url", chunks.extract_article(F.col("html")).alias("text"))


def _redirects(v: Views) -> DataFrame:
    link = F.concat(F.lit("https://www.reuters.com/markets/companies/"), F.col("symbol"))
    code = F.translate(F.regexp_replace(F.base64(link.cast("binary")), "=", ""), "+/", "-_")
    code = F.when(F.col("days_old") % 2 == 0, F.concat(F.lit("CBM"), code)).otherwise(code)
    return v.companies.select("symbol", text.decode_redirect_url(F.concat(F.lit("https://news.google.com/rss/articles/"), code, F.lit("?oc=5"))).alias("decoded"))


def _listing(v: Views) -> DataFrame:
    """Articles as a listing has them: relative, absolute and other URLs."""
    path = F.concat(F.lit("news/"), F.col("article_id").cast("string"))
    kind = F.pmod(F.col("article_id"), F.lit(3))
    url = F.when(kind == 0, F.concat(F.lit("/"), path)).when(kind == 1, F.concat(F.lit("https://h.example/"), path)).otherwise(F.concat(F.lit("ftp:"), path))
    rows = v.articles.select("article_id", url.alias("url"), text.title_of(F.col("text")).alias("title"), F.col("text").alias("summary"))
    return text.normalize_listing(rows, "https://base.example").select("article_id", "url", F.sha2("title", 256).alias("title"), "summary")


def _published(v: Views) -> DataFrame:
    """Times of requests written in six formats, and read."""
    t = F.col("request_timestamp")
    zone = {0: "yyyy-MM-dd'T'HH:mm:ss'Z'", 1: "yyyy-MM-dd'T'HH:mm:ss", 2: "yyyy-MM-dd HH:mm:ss", 3: "yyyyMMdd'T'HHmmss", 4: "EEE, d MMM yyyy HH:mm:ss 'GMT'", 5: "yyyy-MM-dd"}
    said = F.when(F.col("log_id") % 7 == 6, "not a time")
    for i, form in zone.items():
        said = said.when(F.col("log_id") % 7 == i, F.date_format(t, form))
    return v.usage_logs.select("log_id", text.parse_published(said).alias("published"))


def _titles(v: Views) -> DataFrame:
    """Polarity (score) and compound of each article's title."""
    polarity, compound = sentiment.title_score(text.title_of(F.col("text")))
    return v.articles.select("article_id", polarity.alias("score"), compound.alias("compound"))


#: Words of test passages beside the finance keywords.
_KEYWORDS = (*text.PASSAGE, "on", "th")


def _passages(v: Views) -> DataFrame:
    """Lines of articles that hold a symbol's name, which is the beginning of one of its articles."""
    names = v.articles.groupBy("symbol").agg(F.max(F.trim(F.substring("text", 1, 4))).alias("common_name"))
    lines = v.articles.select("article_id", F.posexplode(F.split("text", "\n")).alias("at", "passage"))
    found = chunks.match_passages(lines, names, "article_id", _KEYWORDS)
    return found.select("article_id", F.col("at").cast("long").alias("at"), "symbol", "title", F.sha2("passage", 256).alias("digest"))


_PASSAGES = rf"""{A}, c as (select symbol, max(trim(substring(text, 1, 4))) as common_name from articles group by 1),
n as (select symbol, symbol as name from c union select symbol, split_part(common_name, ' ', 1) from c),
l as (select article_id, string_split(text, chr(10)) as lines from articles),
p as (select article_id, i - 1 as place, lines[i] as passage from l, lateral (select unnest(range(1, len(lines) + 1)) as i) u)
select distinct article_id, place::bigint as "at", symbol, substring(passage, 1, 100) as title, sha256(passage) as digest
from p join n on name <> '' and contains(passage, name) where length(passage) > 30 and {_contains("lower(passage)", _KEYWORDS)}"""


def _routed(v: Views) -> DataFrame:
    """Articles, some with a consent phrase before their text, some of the title only."""
    kind = F.pmod(F.col("article_id"), F.lit(4))
    said = F.when(kind == 0, F.concat(F.lit("Stock quote soars. "), F.col("text"))).when(kind == 1, F.concat(F.lit("Maker falls short. "), text.title_of(F.col("text")))).otherwise(F.col("text"))
    rows = articles.score_articles(v.articles.withColumn("text", said), lambda c: sentiment.lexicon_score(c, WORDS))
    return rows.select("article_id", "polarity", "compound", "scored_by")


_ROUTED = rf"""{A}, s as (select article_id, case article_id % 4 when 0 then 'Stock quote soars. ' || text when 1 then 'Maker falls short. ' || {_TITLE} else text end as said from articles),
c as (select article_id, trim(substring(regexp_replace(regexp_replace(said, 'https?://[^ 	

]+', '', 'g'), '[ 	

]+', ' ', 'g'), 1, 512)) as clean from s),
d as (select *, lower(clean) as low, {_contains("lower(clean)", sentiment.CONSENT)} as consent from c),
e as (select *, lower(case when consent then substring(clean, 1, 100) when contains(clean, '.') then split_part(clean, '.', 1) else clean end) as t from d),
f as (select *, {_TITLE_POLARITY} as ts, {_lexicon_sql()} as main from e),
g as (select *, (length(clean) < 300 or consent) and abs(ts * 0.9::double) > 0.1 as by_title from f)
select article_id, {r("case when by_title then ts else main end", "polarity")}, {r("case when by_title then ts * 0.9::double else main end", "compound")}, case when by_title then 'title' else 'main' end as scored_by from g"""


def _read_back(v: Views) -> DataFrame:
    """The ten most extreme articles of each symbol as JSON documents, one a symbol, and read from them."""
    path = streamed.root(v, "json")
    item = F.struct(text.title_of(F.col("text")).alias("title"), "text", "url", "source", F.col("article_timestamp").cast("string").alias("timestamp"), "polarity", "compound")
    documents = articles.top_extreme(scored(v)).groupBy("symbol").agg(F.collect_list(item).alias("raw_articles"))
    documents.write.option("maxRecordsPerFile", 1).json(path)
    analyses, rows = files.read_analysis_json(v.spark, path)
    whole = analyses.select("symbol", "total_articles", "overall_sentiment")
    return rows.join(whole, "symbol").select("symbol", "url", "source", "polarity", "compound", F.sha2("text", 256).alias("digest"), "total_articles", "overall_sentiment")


def _symbol_tables(v: Views) -> dict[str, DataFrame]:
    return {s: v.articles.where(F.col("symbol") == s).select("url", "article_id") for s in ("S0", "S1", "S2")}


def _symbol_files(v: Views) -> DataFrame:
    """The articles of each symbol in files of their own, read as one table."""
    path = streamed.root(v, "symbols")
    v.articles.select("symbol", "url", "article_id").write.partitionBy("symbol").parquet(path)
    return files.read_symbol_files(v.spark, path)


def _stream_scores(v: Views) -> DataFrame:
    """Scores that a stream gives the articles whose URL stands for one text only."""
    one = v.articles.groupBy("symbol", F.sha2("url", 256).alias("url_hash")).agg(F.count_distinct("text").alias("texts")).where("texts = 1").select("symbol", "url_hash")
    return streamed.articles(v, lambda c: sentiment.lexicon_score(c, WORDS), NOW).join(one, ["symbol", "url_hash"])


def _modelled(v: Views) -> DataFrame:
    """Labels and scores of a model that each worker loads once: here what a text's length says."""

    def load():
        kinds = ("positive", "negative", "neutral")
        return lambda texts: [(kinds[len(t) % 3], len(t) % 100 / 100) for t in texts]

    return chunks.score_with(v.articles, load).select("article_id", "label", "score")


def _enriched_whole_pairs(v: Views) -> DataFrame:
    """Whole articles with the whole next one as their extracted text."""
    following = v.articles.select((F.col("article_id") - 1).alias("article_id"), F.col("text").alias("extracted"))
    return text.enrich(v.articles.join(following, "article_id", "left"))


def _sketched(v: Views, days: int = 14) -> DataFrame:
    """Calls and users of each endpoint in the last days, from stored daily sketches, beside what an exact count may differ by."""
    path = streamed.root(v, "sketches")
    logs = v.usage_logs
    early, late = logs.where("log_id % 2 = 0"), logs.where("log_id % 2 = 1")  # two loads that share their days
    first, second = (sketches.daily_sketches(x, ["endpoint"], "request_timestamp", ["license_id"], {"ms": F.col("processing_time_ms")}) for x in (early, late))
    sketches.add_days(first, second, ["endpoint"]).write.parquet(path)
    last = F.lit(NOW).cast("date")
    found = sketches.over_days(v.spark.read.parquet(path), ["endpoint"], days, last)
    exact = logs.where((F.to_date("request_timestamp") <= last) & (F.to_date("request_timestamp") > F.date_sub(last, days))).groupBy("endpoint").agg(F.count_distinct("license_id").alias("users"))
    near = F.abs(F.col("license_id") - F.col("users")) <= 0.02 * F.col("users")
    return found.join(exact, "endpoint").select("endpoint", F.col("n").alias("calls"), "ms", "users", near.alias("near"))


def _bad_articles(v: Views) -> DataFrame:
    """Articles with scores half as large again, and what is wrong with them."""
    rows = scored(v).withColumns({"compound": F.col("compound") * 1.5, "title": F.when(F.col("article_id") % 5 > 0, text.title_of(F.col("text"))), "url_hash": F.when(F.col("article_id") % 11 > 0, text.url_hash(F.col("url")))})
    return ingest.with_reasons(rows, ingest.article_rules()).select("article_id", F.array_join("reasons", ";").alias("reasons"))


def _analyses(v: Views) -> DataFrame:
    return v.articles.select("symbol", F.col("article_id").alias("id"), (_now() - F.make_dt_interval(hours=F.pmod(F.col("article_id"), F.lit(97)).cast("int"))).alias("created_at"))


def _sessions(v: Views) -> DataFrame:
    return v.usage_logs.select("license_id", F.col("log_id").alias("session_id"), (F.col("log_id") % 3 > 0).alias("is_live"), (F.col("request_timestamp") + F.expr("interval 10 days")).alias("expires_at"))


def _report(v: Views) -> DataFrame:
    s = scored(v)
    firms = s.groupBy("symbol").agg(F.max("source").alias("industry"))
    by_source = s.groupBy(F.col("source").alias("industry")).agg(F.count(F.lit(1)).alias("n"))
    few = articles.coverage(s, _now()).where("sources >= 15").select("symbol", "n")
    out = articles.symbol_report(articles.sentiment_summary(s).select("symbol", "total"), by_source, few, few.where("false"), firms)
    return out.select("symbol", "industry", F.col("sentiment.total").alias("total"), F.col("industry_view.n").alias("industry_n"), "n_parts")


_JACCARD_WORDS = r"list_distinct(list_filter(string_split(lower(trim(regexp_replace(title, '[ \t\n\r\f\x0B]+', ' ', 'g'))), ' '), lambda w: w <> ''))"
_SETS = f"{A}, t as (select article_id, symbol, {_TITLE} as title from articles), w as (select article_id, symbol, list_sort({_JACCARD_WORDS}) as w from t), f as (select symbol, w, min(article_id) as first from w where len(w) > 0 group by 1, 2)"
_PAIRS = f"{_SETS}, p as (select x.symbol, x.first as a, y.first as b, len(list_intersect(x.w, y.w)) as i, len(x.w) as nx, len(y.w) as ny from f x join f y on x.symbol = y.symbol and x.first < y.first), q as (select symbol, a, b, i / (nx + ny - i) as similarity from p where i / (nx + ny - i) > 0.8)"

def _kept_sql(threshold: float) -> str:
    """Titles kept one by one: each is compared with all that stay before it."""
    both = "len(list_intersect(e, v.w))"
    return f"""{_SETS}, v as (select *, row_number() over (partition by symbol order by article_id) as rn from w),
    k as (select symbol, rn, article_id, [w] as stay, true as kept from v where rn = 1
     union all select symbol, rn, article_id, case when near then stay else list_append(stay, w) end, not near
     from (select v.symbol, v.rn, v.article_id, v.w, k.stay, len(list_filter(k.stay, lambda e: len(e) > 0 and len(v.w) > 0 and {both} / (len(e) + len(v.w) - {both}) > {threshold})) > 0 as near from k join v on v.symbol = k.symbol and v.rn = k.rn + 1))
    select article_id from k where kept"""


_URL_OR_TITLE = f"""{A}, t as (select article_id, symbol, url, lower({_TITLE}) as title from articles), v as (select article_id, symbol, list_filter([case when url <> '' then 'u' || url end, case when title <> '' then 't' || title end], lambda x: x is not null) as vals, row_number() over (partition by symbol order by article_id) as rn from t),
k as (select symbol, rn, article_id, vals as taken, true as kept from v where rn = 1
 union all select v.symbol, v.rn, v.article_id, case when list_has_any(k.taken, v.vals) then k.taken else list_concat(k.taken, v.vals) end, not list_has_any(k.taken, v.vals) from k join v on v.symbol = k.symbol and v.rn = k.rn + 1)
select article_id from k where kept"""

SOURCES = {
    "clean_text": (lambda v: v.articles.select("article_id", F.sha2(text.clean_text(F.col("text")), 256).alias("digest")), f"{A} select article_id, sha256({_CLEAN}) as digest from articles"),
    "strip_markup": (
        lambda v: v.table("pages").select("page_id", text.strip_markup(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest")),
        r"select page_id, length(t) as n, sha256(t) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[[^\]]*\]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) as t from pages)",
    ),
    "clean_for_analysis": (
        lambda v: v.articles.select("article_id", text.clean_for_analysis(F.col("text")).alias("clean")),
        A + r" select article_id, trim(substring(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r]+', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), 1, 512)) as clean from articles",
    ),
    "title_of": (lambda v: v.articles.select("article_id", text.title_of(F.col("text")).alias("title")), f"{A} select article_id, {_TITLE} as title from articles"),
    "legitimate": (
        lambda v: v.articles.select("article_id", text.is_legitimate(F.col("text")).alias("ok")),
        f"{A}, {_ARTICLE} select article_id, ({' + '.join(f'contains(low, {p!r})::int' for p in text.JUNK)}) <= 3 and len(list_filter(string_split(text, '.'), lambda s: length(trim(s)) > 20)) >= 3 as ok from a",
    ),
    "paywalled": (
        lambda v: v.articles.select("article_id", text.is_paywalled(F.col("text"), F.col("url")).alias("paywalled")),
        f"{A}, {_ARTICLE} select article_id, {_contains('low', text.PAYWALL)} or {_contains('lower(url)', text.PAYWALL_URL)} as paywalled from a",
    ),
    "relevance": (
        lambda v: v.articles.select("article_id", text.is_relevant(text.title_of(F.col("text")), F.col("text"), F.lit("onthe"), F.col("source")).alias("basic"), text.is_relevant_ext(text.title_of(F.col("text")), F.col("text"), F.lit("onthe"), F.lit("thth ering inc")).alias("extended"), text.company_words(F.col("text"), F.lit("tion ering inc")).alias("n_words")),
        f"""{A}, {_ARTICLE}, t as (select *, {_TITLE} as title from a), u as (select *, lower(title) || ' ' || low as whole from t)
        select article_id, contains(whole, 'onthe') or contains(whole, lower(source)) as basic, contains(whole, 'onthe') or contains(whole, 'thth') or contains(whole, 'ering') or ({_contains("lower(title)", text.FINANCE)} and length(title) > 20) as extended,
        (contains(low, 'tion')::int + contains(low, 'ering')::int)::bigint as n_words from u""",
    ),
    "match_symbols": (
        lambda v: articles.match_symbols(v.articles, v.articles.groupBy("source").agg(F.min("article_id").alias("i")).select(F.col("source").alias("symbol"), F.when(F.col("i") % 2 == 0, "the").otherwise("que").alias("common_name"))),
        rf"""{A}, c as (select source as symbol, case when min(article_id) % 2 = 0 then 'the' else 'que' end as name from articles group by 1), w as (select distinct article_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) as word from articles)
        select distinct article_id, symbol from w join (select symbol, name from c union select symbol, lower(symbol) from c) on word = name""",
    ),
    "url_hash": (lambda v: v.articles.select("article_id", text.url_hash(F.col("url")).alias("url_hash")), f"{A} select article_id, sha256(url) as url_hash from articles"),
    "known_urls": (
        lambda v: lookup.mark_known(v.articles.select("article_id", "symbol", text.url_hash(F.col("url")).alias("url_hash")), v.articles.where("article_id % 2 = 0").select("symbol", text.url_hash(F.col("url")).alias("url_hash")), ["symbol", "url_hash"]).select("article_id", "known"),
        f"{A} select article_id, exists (select 1 from articles b where b.article_id % 2 = 0 and b.symbol = a.symbol and b.url = a.url) as known from articles a",
    ),
    "decode_redirect_url": (_redirects, prefix("companies") + " select symbol, 'https://www.reuters.com/markets/companies/' || symbol as decoded from companies"),
    "truncate_sentences": (
        lambda v: v.articles.select("article_id", text.truncate_sentences(F.col("text"), 300).alias("cut")),
        f"""{A}, p as (select article_id, unnest(string_split(text, '. ')) as s, generate_subscripts(string_split(text, '. '), 1) as i from articles), c as (select *, sum(length(s) + 2) over (partition by article_id order by i) as upto from p),
        m as (select article_id, min(case when upto > 300 then i end) as stop from c group by 1), k as (select c.article_id, string_agg(s || '. ', '' order by i) as t from c join m on m.article_id = c.article_id where stop is null or i < stop group by 1)
        select a.article_id, case when text is null or length(text) <= 300 then text else trim(coalesce(t, '')) || '...' end as cut from articles a left join k on k.article_id = a.article_id""",
    ),
    "parse_published": (
        _published,
        prefix("usage_logs") + """ select log_id, case when log_id % 7 = 6 then null when log_id % 7 = 5 then cast(epoch(date_trunc('day', request_timestamp)) as bigint) else cast(floor(epoch(request_timestamp)) as bigint) end as published from usage_logs""",
    ),
    "normalize_listing": (
        _listing,
        f"""{A}, t as (select *, {_TITLE} as title from articles) select article_id, case article_id % 3 when 0 then 'https://base.example/news/' else 'https://h.example/news/' end || article_id as url, sha256(title) as title,
        case when length(text) > 20 then substring(text, 1, 200) end as summary from t where article_id % 3 < 2 and length(title) >= 15""",
    ),
    "quarantine_articles": (
        _bad_articles,
        f"""{SCORED} select article_id, concat_ws(';', case when abs(compound * 1.5) > 1 then '-1 <= compound <= 1' end, case when article_id % 5 = 0 or text is null then 'title' end, case when article_id % 11 = 0 then 'url_hash' end) as reasons from s""",
    ),
    "analysis_documents": (
        _read_back,
        f"""{SCORED}, x as (select * from s qualify row_number() over (partition by symbol order by abs(compound) desc, article_id) <= 10)
        select symbol, url, source, {r("polarity")}, {r("compound")}, sha256(text) as digest, cast(count(*) over (partition by symbol) as int) as total_articles, 'Neutral' as overall_sentiment from x""",
    ),
    "sources": (lambda v: articles.sources(v.articles), f"{A} select distinct source from articles where source is not null"),
    "union_symbol_tables": (lambda v: files.union_symbol_tables(_symbol_tables(v)), f"{A} select symbol, sha256(url) as url_hash, url, min(article_id) as article_id from articles where symbol in ('S0', 'S1', 'S2') group by symbol, url"),
    "union_report": (lambda v: files.union_report(_symbol_tables(v)), f"{A} select symbol, count(*) as n_rows, count(distinct url) as n_kept, count(*) - count(distinct url) as duplicates from articles where symbol in ('S0', 'S1', 'S2') group by 1"),
    "union_symbol_files": (lambda v: files.union_symbol_files(_symbol_files(v)), f"{A} select symbol, sha256(url) as url_hash, url, min(article_id) as article_id from articles group by symbol, url"),
    "symbol_files_report": (lambda v: files.symbol_files_report(_symbol_files(v)), f"{A} select symbol, count(*) as n_rows, count(distinct url) as n_kept, count(*) - count(distinct url) as duplicates from articles group by 1"),
    "stream_scores": (
        _stream_scores,
        f"""{A}, {_ARTICLE}, o as (select symbol, url, min(low) as low from a group by 1, 2 having count(distinct text) = 1)
        select symbol, sha256(url) as url_hash, {r(_lexicon_sql(), 'score')} from o""",
    ),
    "usage_sketched": (
        _sketched,
        prefix("usage_logs") + f""" select endpoint, count(*) as calls, sum(processing_time_ms)::bigint as ms, count(distinct license_id) as users, true as near from usage_logs
        where cast(request_timestamp as date) <= date '{NOW[:10]}' and cast(request_timestamp as date) > date '{NOW[:10]}' - 14 group by 1""",
    ),
    "score_with": (_modelled, f"{A} select article_id, ['positive', 'negative', 'neutral'][(length(text) % 3 + 1)::int] as label, {r('(length(text) % 100) / 100.0::double', 'score')} from articles"),
    "enrich_digests": (
        lambda v: _enriched_whole_pairs(v).select("article_id", F.sha2("full_text", 256).alias("digest"), "extraction_successful", "enhancement_ratio"),
        f"""{A}, e as (select a.article_id, a.text, b.text as extracted from articles a left join articles b on b.article_id = a.article_id + 1), x as (select *, coalesce(length(text), 0) as la, coalesce(length(extracted), 0) as lb from e)
        select article_id, sha256(case when lb > la then concat_ws(' ', text, extracted) else text end) as digest, lb > 100 as extraction_successful, round(100.0::double * lb / greatest(1, la), 1) as enhancement_ratio from x""",
    ),
    "cached_digests": (
        lambda v: lookup.cached_analysis(_analyses(v), v.articles, 24, _now(), 50).select("symbol", "id", F.sha2("articles", 256).alias("digest")),
        f"""{A}, y as (select symbol, article_id as id, timestamp '{NOW}' - to_hours(cast(article_id % 97 as int)) as tm from articles), l as (select symbol, max_by(id, (tm, id)) as id from y where tm > timestamp '{NOW}' - interval 24 hours group by 1),
        n as (select symbol, sha256('[' || string_agg('{{"article_id":' || article_id || ',"source":"' || source || '"}}', ',' order by article_id, source) || ']') as digest from articles group by 1)
        select symbol, id, digest from l join n using (symbol)""",
    ),
    "strip_markup_long": (
        lambda v: text.long_enough(v.table("pages"), "html", 2000).select("page_id", F.sha2("html", 256).alias("digest")),
        r"select page_id, sha256(t) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[[^\]]*\]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) as t from pages) where length(t) >= 2000",
    ),
    "stream_articles": (lambda v: streamed.articles(v, lambda c: sentiment.lexicon_score(c, WORDS), NOW).select("symbol", "url_hash"), f"{A} select distinct symbol, sha256(url) as url_hash from articles"),
    "stream_usage": (
        lambda v: streamed.usage(v),
        prefix("usage_logs") + " select license_id, cast(epoch(time_bucket(interval 5 minutes, request_timestamp)) as bigint) - 300 * k as window_start, count(*) as calls from usage_logs, unnest(range(12)) as u(k) group by 1, 2",
    ),
    "score_articles": (_routed, _ROUTED),
    "enrich_articles": (
        lambda v: _enriched(v).select("article_id", F.length("full_text").cast("long").alias("n"), "extraction_successful", "enhancement_ratio"),
        f"{_ENRICHED} select article_id, cast(case when lb > la then la + 1 + lb else la end as bigint) as n, lb > 100 as extraction_successful, round(100.0::double * lb / greatest(1, la), 1) as enhancement_ratio from x",
    ),
    "enrich_articles_whole": (lambda v: _enriched_whole(v).select("article_id", F.length("full_text").cast("long").alias("n"), "extraction_successful", "enhancement_ratio"), None),
    "enhancement_stats_whole": (lambda v: articles.enhancement_stats(_enriched_whole(v)), None),
    "title_score": (_titles, f"{A}, t as (select article_id, lower({_TITLE}) as t from articles), p as (select article_id, {_TITLE_POLARITY} as score from t) select article_id, {r('score')}, {r('score * 0.9::double', 'compound')} from p"),
    "lexicon_score": (lambda v: v.articles.select("article_id", sentiment.lexicon_score(F.col("text"), WORDS).alias("score")), f"{A}, {_ARTICLE} select article_id, {r(_lexicon_sql(), 'score')} from a"),
    "boost_score": (lambda v: v.articles.select("article_id", sentiment.boost_score(F.col("text")).alias("score")), f"{A}, {_ARTICLE} select article_id, {r(_BOOST, 'score')} from a"),
    "combine_lexicon": (
        _combined,
        f"{A}, {_ARTICLE}, j as (select article_id, {_lexicon_sql()} + {_BOOST} as adj from a), p as (select article_id, greatest(-1, least(1, case when abs(adj) > 0.1 then adj * 1.5 else 0.05 + adj end)) as polarity from j) select article_id, {r('polarity')}, {r('polarity * 0.5', 'compound')} from p",
    ),
    "calibrate": (
        _calibrated,
        f"""{A}, {_ARTICLE}, b as (select article_id, {_MODEL_BOOST} as boost, case article_id % 3 when 0 then 1.0 when 1 then -1.0 else 0.0 end as sign, article_id % 3 = 2 as neutral, (article_id % 100) / 100.0::double as score from a)
        select article_id, {r("greatest(-1, least(1, case when neutral and abs(boost) > 0.2 then boost else sign * score * 0.8 + boost * 0.5 end))", "polarity")}, {r("greatest(-1, least(1, case when neutral and abs(boost) > 0.2 then boost else sign * score + boost * 0.3 end))", "compound")} from b""",
    ),
    "sentiment_label": (
        lambda v: scored(v).select("article_id", sentiment.sentiment_label(F.col("compound")).alias("label")),
        f"{SCORED} select article_id, case when compound > 0.75 then 'Very Positive' when compound > 0.05 then 'Positive' when compound < -0.75 then 'Very Negative' when compound < -0.05 then 'Negative' else 'Neutral' end as label from s",
    ),
    "filter_articles": (
        lambda v: articles.filter_articles(scored(v).withColumn("label", sentiment.sentiment_label(F.col("compound"))), "positive", "src1").select("article_id"),
        f"{SCORED} select article_id from s where compound > 0.05 and source = 'src1'",
    ),
    "chunk_text": (lambda v: v.articles.select("article_id", chunks.chunk_text(F.col("text")).alias("c")).select("article_id", F.size("c").alias("n_chunks"), F.sha2(F.array_join("c", "\n"), 256).alias("digest")), None),
    "score_long": (lambda v: chunks.score_long(v.articles, "article_id", "text", lambda c: sentiment.lexicon_score(c, WORDS)), None),
    "extract_article": (_pages_text, None),
    "find_passages": (lambda v: chunks.find_passages(v.table("pages"), v.articles.select("symbol").distinct().withColumn("common_name", F.lit("The")), "page_id", "html", _KEYWORDS), None),
    "match_passages": (_passages, _PASSAGES),
    "dedupe_url": (
        lambda v: dedup.dedupe_by_key(v.articles.withColumn("url_hash", text.url_hash(F.col("url"))), ["symbol", "url_hash"], "article_id").select("article_id", "symbol"),
        f"{A} select min(article_id) as article_id, symbol from articles group by symbol, url",
    ),
    "duplicate_report": (lambda v: dedup.duplicate_report(v.articles, ["symbol", "url"], "symbol"), f"{A} select symbol, count(*) as total, count(distinct url) as new, count(*) - count(distinct url) as duplicates from articles group by 1"),
    "near_duplicates": (lambda v: dedup.similar_pairs(v.articles.withColumn("w", dedup.title_words(text.title_of(F.col("text")))), "symbol", "article_id", "w"), f"{_PAIRS} select symbol, a, b, {r('similarity')} from q"),
    "near_duplicates_lsh": (lambda v: dedup.similar_pairs_lsh(v.articles.withColumn("w", dedup.title_words(text.title_of(F.col("text")))), "symbol", "article_id", "w"), f"{_PAIRS} select symbol, a, b, {r('similarity')} from q"),
    "near_duplicate_classes": (
        lambda v: dedup.title_classes(v.articles.withColumn("w", dedup.title_words(text.title_of(F.col("text")))), "symbol", "article_id", "w"),
        f"""{_PAIRS}, e as (select w.article_id, w.symbol, coalesce(f.first, w.article_id) as class_id from w left join f on w.symbol = f.symbol and w.w = f.w),
        d as (select id, count(*) as links from (select a as id from q union all select b as id from q) group by 1)
        select article_id, symbol, class_id, coalesce(links, 0)::bigint as links from e left join d on id = class_id""",
    ),
    "near_duplicates_kept": (lambda v: dedup.dedupe_similar_titles(v.articles, "symbol", "article_id", text.title_of(F.col("text"))).select("article_id"), _kept_sql(0.8)),
    "near_duplicates_kept_loose": (lambda v: dedup.dedupe_similar_titles(v.articles, "symbol", "article_id", text.title_of(F.col("text")), 0.7).select("article_id"), _kept_sql(0.7)),
    "dedupe_url_or_title": (lambda v: dedup.dedupe_url_or_title(v.articles, "symbol", "article_id", "url", text.title_of(F.col("text"))).select("article_id"), _URL_OR_TITLE),
    "score_distinct": (
        lambda v: dedup.score_distinct(v.articles, "text", lambda c: sentiment.lexicon_score(c, WORDS)).select("article_id", "score"),
        f"{A}, {_ARTICLE} select article_id, {r(_lexicon_sql(), 'score')} from a",
    ),
    "sentiment_summary": (
        lambda v: articles.sentiment_summary(scored(v)),
        f"""{SCORED}, g as (select symbol, count(*) as total, avg(polarity) as avg_polarity, avg(compound) as avg_compound, count_if(compound > 0.01) as positive, count_if(compound < -0.01) as negative, count_if(compound between -0.01 and 0.01) as neutral from s group by 1),
        b as (select symbol, source, count(*) as n, avg(compound) as c from s group by 1, 2), x as (select symbol, sum(c * n) / sum(n) as w from b group by 1)
        select symbol, total, {r("avg_polarity")}, {r("avg_compound")}, positive, negative, neutral, round(positive * 100.0::double / total, 1) as positive_pct, round(negative * 100.0::double / total, 1) as negative_pct, round(neutral * 100.0::double / total, 1) as neutral_pct,
        case when round(avg_compound, 9) > 0.1 then 'Very Positive' when round(avg_compound, 9) > 0.01 then 'Positive' when round(avg_compound, 9) < -0.1 then 'Very Negative' when round(avg_compound, 9) < -0.01 then 'Negative' else 'Neutral' end as overall, {r("w", "weighted_avg")} from g join x using (symbol)""",
    ),
    "source_breakdown": (lambda v: articles.source_breakdown(scored(v)), f"{SCORED} select symbol, source, count(*) as n, {r('avg(compound)', 'avg_compound')} from s group by 1, 2"),
    "summary_wide": (
        lambda v: files.summary_wide(scored(v), ["src0", "src1"]),
        f"{SCORED} select symbol, count(*) as total, count_if(source = 'src0') as src0_Count, {r(chr(39).join(['avg(case when source = ', 'src0', ' then compound end)']), 'src0_Avg_Sentiment')}, count_if(source = 'src1') as src1_Count, {r(chr(39).join(['avg(case when source = ', 'src1', ' then compound end)']), 'src1_Avg_Sentiment')} from s group by 1",
    ),
    "enhancement_stats": (
        lambda v: articles.enhancement_stats(_enriched(v)),
        f"{_ENRICHED} select symbol, source, count(*) as n, count_if(lb > 100) as enhanced, cast(coalesce(sum(case when lb > 100 then lb end), 0) as bigint) as chars, {r('avg(case when lb > 100 then lb end)', 'avg_chars')} from x group by grouping sets ((symbol), (symbol, source))",
    ),
    "sentiment_trend": (
        lambda v: articles.sentiment_trend(scored(v), _now()),
        f"""{SCORED} select symbol, count_if(tm > timestamp '{NOW}' - interval 24 hours) as n_day, {r(f"avg(case when tm > timestamp '{NOW}' - interval 24 hours then compound end)", "avg_day")}, count_if(tm > timestamp '{NOW}' - interval 168 hours) as n_week, {r(f"avg(case when tm > timestamp '{NOW}' - interval 168 hours then compound end)", "avg_week")}, count(*) as n_all, {r("avg(compound)", "avg_all")} from s group by 1""",
    ),
    "coverage": (
        lambda v: articles.coverage(scored(v), _now()),
        f"""{SCORED}, g as (select symbol, count(*) as n, count(distinct source) as sources, max(tm) as m from s group by 1) select symbol, n, sources, least(sources / 8.0::double, 1.0) as diversity, case when n >= 30 then 'High' when n >= 15 then 'Medium' else 'Low' end as sample_class, case when sources >= 6 then 'High' when sources >= 4 then 'Medium' else 'Low' end as source_class, m > timestamp '{NOW}' - interval 1 day as is_recent from g""",
    ),
    "article_counts": (lambda v: articles.article_counts(v.articles), f"{A} select symbol, source, count(*) as n, min(article_id) as first_id, max(article_id) as last_id from articles group by cube (symbol, source)"),
    "top_extreme": (lambda v: articles.top_extreme(scored(v)).select("article_id", "symbol"), f"{SCORED} select article_id, symbol from s qualify row_number() over (partition by symbol order by abs(compound) desc, article_id) <= 10"),
    "recent_sample": (
        lambda v: articles.recent_sample(v.articles).select("article_id", "text"),
        f"{A} select article_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as text from articles qualify row_number() over (partition by symbol order by article_id desc) <= 5",
    ),
    "recent_articles": (
        lambda v: lookup.recent(scored(v), "article_timestamp", _now(), 100, 10, ["symbol"], "article_id").select("article_id", "symbol"),
        f"{SCORED} select article_id, symbol from s where tm > timestamp '{NOW}' - interval 100 hours qualify row_number() over (partition by symbol order by tm desc, article_id desc) <= 10",
    ),
    "cached_analysis": (
        lambda v: lookup.cached_analysis(_analyses(v), v.articles, 24, _now(), 50).select("symbol", "id", "n_articles", F.length("articles").cast("long").alias("json_length"), "hit"),
        f"""{A}, y as (select symbol, article_id as id, timestamp '{NOW}' - to_hours(cast(article_id % 97 as int)) as tm from articles), l as (select symbol, max_by(id, (tm, id)) as id from y where tm > timestamp '{NOW}' - interval 24 hours group by 1),
        n as (select symbol, count(*) as n, 2 + sum(length('{{"article_id":' || article_id || ',"source":"' || source || '"}}')) + count(*) - 1 as j from articles group by 1)
        select symbol, id, n as n_articles, cast(j as bigint) as json_length, n >= 50 as hit from l join n using (symbol)""",
    ),
    "symbol_report": (
        _report,
        f"""{SCORED}, f as (select symbol, max(source) as industry from s group by 1), t as (select symbol, count(*) as total, count(distinct source) as k from s group by 1), i as (select source as industry, count(*) as industry_n from s group by 1)
        select f.symbol, f.industry, total, industry_n, cast(2 + (k >= 15)::int as int) as n_parts from f join t using (symbol) join i using (industry)""",
    ),
    "companies_by_industry": (
        lambda v: companies.companies_by_industry(v.companies).select("industry", "n", F.array_join("symbols", ",").alias("symbols"), F.md5(F.array_join("names", ",")).alias("names"), "avg_days"),
        prefix("companies") + f" select industry, count(*) as n, string_agg(symbol, ',' order by symbol) as symbols, md5(string_agg(company_name, ',' order by symbol)) as names, {r('avg(days_old)', 'avg_days')} from companies group by 1",
    ),
    "display_names": (lambda v: companies.display_names(v.companies), prefix("companies") + " select symbol, company_name || ' (' || symbol || ')' as label from companies"),
    "company_status": (lambda v: companies.company_status(v.companies).select("symbol", "status"), prefix("companies") + " select symbol, case when days_old > 30 then 'NEEDS_UPDATE' when days_old > 14 then 'AGING' else 'FRESH' end as status from companies"),
    "companies_to_refresh": (lambda v: companies.companies_to_refresh(v.companies).select("symbol", "days_old"), prefix("companies") + " select symbol, days_old from companies where days_old > 30"),
    "company_upsert": (
        lambda v: companies.upsert_company(v.companies.where("days_old > 10"), v.companies.where("days_old <= 20").withColumns({"symbol": F.lower("symbol"), "common_name": F.when(F.col("days_old") % 2 == 0, "new")})).select("symbol", "common_name"),
        prefix("companies") + " select symbol, case when days_old <= 20 and days_old % 2 = 0 then 'new' when days_old > 10 then common_name end as common_name from companies",
    ),
    "companies_in_industry": (lambda v: companies.companies_in_industry(v.companies, "steel").select("symbol"), prefix("companies") + " select symbol from companies where industry ilike '%steel%'"),
    "company_lookup": (
        lambda v: lookup.with_company(v.companies.select("symbol"), v.companies),
        prefix("companies") + " select symbol, case when days_old <= 30 then company_name else symbol end as company_name, case when days_old <= 30 then industry else 'Unknown' end as industry from companies",
    ),
    "industry_overview": (lambda v: companies.industry_overview(v.industry_analyses).select("industry", "id", "overall_sentiment"), prefix("industry_analyses") + " select industry, id, overall_sentiment from industry_analyses qualify row_number() over (partition by industry order by created_at desc, id desc) = 1"),
    "industry_dashboard": (
        lambda v: companies.industry_dashboard(v.industry_analyses),
        prefix("industry_analyses") + """, l as (select * from industry_analyses qualify row_number() over (partition by industry order by created_at desc, id desc) = 1)
        select count(*) as industries, count_if(overall_sentiment > 0.05) as positive, count_if(overall_sentiment < -0.05) as negative, count_if(overall_sentiment between -0.05 and 0.05) as neutral,
        (select string_agg(industry, ',' order by overall_sentiment desc, industry desc) from (select * from l order by overall_sentiment desc, industry desc limit 3)) as best from l""",
    ),
    "analysis_history": (
        lambda v: companies.analysis_history(v.industry_analyses, "industry", 20, F.lit("2001-08-02").cast("timestamp")).select("industry", "id", "age_hours"),
        prefix("industry_analyses") + f" select industry, id, {r(chr(39).join(['(epoch(timestamp ', '2001-08-02', ') - epoch(created_at)) / 3600']), 'age_hours')} from industry_analyses qualify row_number() over (partition by industry order by created_at desc, id desc) <= 20",
    ),
    "usage_by_key": (
        lambda v: usage.usage_by_key(v.licenses, v.tiers, v.usage_logs, 20, _now()),
        prefix("tiers", "licenses", "usage_logs") + f""", l as (select * from usage_logs where request_timestamp > timestamp '{NOW}' - interval 20 days)
        select k.license_id, t.tier_name, count(l.log_id) as calls, count(distinct cast(l.request_timestamp as date)) as active_days, {r("avg(l.processing_time_ms)", "avg_ms")}, cast(sum(l.request_size + l.response_size) as bigint) as bytes
        from licenses k join tiers t using (tier_id) left join l on l.license_id = k.license_id group by 1, 2""",
    ),
    "usage_by_tier": (
        lambda v: usage.usage_by_tier(v.licenses, v.tiers, v.usage_logs, 20, _now()),
        prefix("tiers", "licenses", "usage_logs") + f""", l as (select license_id, count(*) as c, sum(processing_time_ms) as ms, sum(request_size + response_size) as b from usage_logs where request_timestamp > timestamp '{NOW}' - interval 20 days group by 1)
        select t.tier_id, t.tier_name, count(distinct k.license_id) as keys, count(distinct case when k.is_active then k.license_id end) as active_keys, cast(coalesce(sum(c), 0) as bigint) as calls, {r("sum(ms) / sum(c)", "avg_ms")}, cast(sum(b) as bigint) as bytes from tiers t left join licenses k using (tier_id) left join l using (license_id) group by 1, 2""",
    ),
    "rate_limit_audit": (
        lambda v: usage.rate_limit_audit(v.usage_logs, v.licenses, v.tiers),
        prefix("tiers", "licenses", "usage_logs") + """, w as (select *, count(*) over (partition by license_id order by epoch_us(request_timestamp) range between 3599999999 preceding and 1 preceding) as h,
        count(*) over (partition by license_id order by epoch_us(request_timestamp) range between 86399999999 preceding and 1 preceding) as d from usage_logs)
        select log_id, w.license_id, h as calls_hour, d as calls_day, case when max_calls_per_hour > 0 and h >= max_calls_per_hour then 'hour' when max_calls_per_day > 0 and d >= max_calls_per_day then 'day' else 'ok' end as verdict
        from w join licenses using (license_id) join tiers using (tier_id)""",
    ),
    "session_audit": (
        lambda v: usage.session_audit(_sessions(v), v.licenses, v.tiers.withColumn("max_sessions", F.col("max_calls_per_day") * 5), _now()),
        prefix("tiers", "licenses", "usage_logs") + f""", s as (select license_id, count_if(log_id % 3 > 0 and request_timestamp + interval 10 days > timestamp '{NOW}') as a, count_if(request_timestamp + interval 10 days <= timestamp '{NOW}') as x from usage_logs group by 1)
        select license_id, coalesce(a, 0) as active, coalesce(x, 0) as expired, max_calls_per_day * 5 as max_sessions, max_calls_per_day * 5 <= 0 or coalesce(a, 0) < max_calls_per_day * 5 as may_open from licenses join tiers using (tier_id) left join s using (license_id)""",
    ),
    "source_health": (
        lambda v: usage.source_health(v.usage_logs.select(F.concat_ws("-", "endpoint", F.pmod("license_id", F.lit(10))).alias("source"), (F.col("processing_time_ms") > 150).alias("success"))),
        prefix("usage_logs") + f" select endpoint || '-' || (license_id % 10) as source, count(*) as attempts, count_if(processing_time_ms > 150) as successes, {r('count_if(processing_time_ms > 150) / count(*)', 'rate')}, count(*) >= 10 and count_if(processing_time_ms > 150) * 10 < count(*) as disabled from usage_logs group by 1",
    ),
    "throughput_report": (
        lambda v: articles.throughput_report(v.usage_logs.groupBy("endpoint").agg(F.count(F.lit(1)).alias("articles"), F.sum("processing_time_ms").alias("seconds"))),
        prefix("usage_logs") + f", g as (select endpoint, count(*) as articles, cast(sum(processing_time_ms) as bigint) as seconds from usage_logs group by 1) select endpoint, articles, seconds, {r('articles / seconds', 'per_second')}, {r('seconds / articles', 'seconds_each')}, case when articles / seconds > 1 then 'HIGH' when articles / seconds > 0.5 then 'MEDIUM' else 'LOW' end as class from g",
    ),
}
