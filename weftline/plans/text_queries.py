"""Queries over pages, texts and names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import GOVERNORATES
from weftline.functions import text as tx
from weftline.operators.names import canonical_names
from weftline.operators.serving import governorates
from weftline.plans.registry import query
from weftline.sources.fetch import crawl
from weftline.sources.views import Views


@query("q_scan_pages", "select page_id, url, length(html) as n_chars from pages")
def scan_pages(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("q_page_links", """select link, count(*) as n from (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages) where link like '/%' group by link""")
def page_links(v: Views) -> DataFrame:
    links = v.raw("pages").select(F.explode(tx.page_links(F.col("html"))).alias("link"))
    return links.filter(F.col("link").startswith("/")).groupBy("link").agg(F.count("*").alias("n"))


@query("q_crawl_fresh_links", "with s as (select distinct string_split(rtrim(url, '/'), '/')[-1] as slug, page_id from pages), k as (select distinct slug from s where page_id <= (select avg(page_id) from pages)) select slug, min(page_id) as first_page from s where slug not in (select slug from k) group by slug")
def crawl_fresh_links(v: Views) -> DataFrame:
    """Pages of the newer half whose id the older half has not shown."""
    own = v.raw("pages").select(tx.slug(F.col("url")).alias("slug"), "page_id")
    mid = v.raw("pages").agg(F.avg("page_id").alias("mid"))
    split = own.crossJoin(mid)  # one row
    known = split.filter("page_id <= mid").select("slug").distinct()
    return split.filter("page_id > mid").join(known, "slug", "left_anti").groupBy("slug").agg(F.min("page_id").alias("first_page"))


_LINKS = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""


@query(
    "q_crawl",
    f"with s as (select page, link, min(i) as place from (select page_id as page, unnest({_LINKS}) as link, generate_subscripts({_LINKS}, 1) - 1 as i from pages) group by page, link), f as (select link, min(struct_pack(p := page, i := place)) as w from s group by link), e as (select min(page_id) as ended from pages where page_id not in (select w.p from f)) select w.p as page, w.i as place, link as id from f cross join e where (ended is null or w.p < ended) and link not in (select url from pages)",
)
def crawl_links(v: Views) -> DataFrame:
    """Links that the pages show for the first time, up to the first page that shows none, without those of pages we hold."""
    shown = v.raw("pages").select(F.col("page_id").alias("page"), tx.page_links(F.col("html")).alias("ids"))
    return crawl(shown, v.raw("pages").select(F.col("url").alias("id"))).withColumn("place", F.col("place").cast("long"))


@query("q_table_zones", "select page_id, scope, header, ordinal, zone from (select page_id, 0 as scope, concat('جهة ', string_split(url, '/')[3]) as header, 0 as ordinal, url as zone from pages where url <> '' union all select page_id, 0, concat('جهة ', string_split(url, '/')[3]), 1, concat('page ', cast(page_id as varchar)) from pages union all select page_id, 1, null, 0, cast(page_id as varchar) from pages)")
def table_zones(v: Views) -> DataFrame:
    """Zones of notices whose localities stand in the cells of a table, the first cell under a header."""
    region = F.get(F.split("url", "/"), F.lit(2))
    html = F.concat(F.lit("<p>x</p><table><tr><td>جهة "), region, F.lit("<br> - "), "url", F.lit("\n-page "), F.col("page_id").cast("string"), F.lit("</td><td> </td><td>– "), F.col("page_id").cast("string"), F.lit("</td></tr></table><table><td>later</td></table><ul><li>no</li></ul>"))
    return v.raw("pages").select("page_id", F.inline(tx.zones_column(html)))


@query("q_slug", "select page_id, string_split(rtrim(url, '/'), '/')[-1] as slug from pages")
def slug(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("q_page_title", """select page_id, trim(string_split(replace(replace(replace(replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' | ')[1]) as title from pages""")
def page_title(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


@query("q_li_zones", "select page_id, ordinal - 1 as ordinal, zone from (select page_id, unnest(z) as zone, generate_subscripts(z, 1) as ordinal from (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '') as z from pages))")
def li_zones(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", F.posexplode(tx.list_items(F.col("html"))).alias("ordinal", "zone")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("q_title_parse", r"select page_id, nullif(regexp_extract(t, 'إشعار بانقطاع الكهرباء\s*-\s*(.+?)\s*-\s*(\d{1,2}:\d{2})\s+(\d{2}/\d{2}/\d{4})', 1), '') as region, nullif(regexp_extract(t, 'إشعار بانقطاع الكهرباء\s*-\s*(.+?)\s*-\s*(\d{1,2}:\d{2})\s+(\d{2}/\d{2}/\d{4})', 2), '') as time, nullif(regexp_extract(t, 'إشعار بانقطاع الكهرباء\s*-\s*(.+?)\s*-\s*(\d{1,2}:\d{2})\s+(\d{2}/\d{2}/\d{4})', 3), '') as date from (select page_id, case when page_id % 3 = 0 then url else concat('إشعار بانقطاع الكهرباء - ', string_split(url, '/')[3], ' - 0', cast(page_id % 10 as varchar), ':30 1', cast(page_id % 9 as varchar), '/07/2026') end as t from pages)")
def title_parse(v: Views) -> DataFrame:
    page = F.col("page_id")
    made = F.concat(F.lit("إشعار بانقطاع الكهرباء - "), F.get(F.split("url", "/"), F.lit(2)), F.lit(" - 0"), (page % 10).cast("string"), F.lit(":30 1"), (page % 9).cast("string"), F.lit("/07/2026"))
    titles = v.raw("pages").select("page_id", F.when(page % 3 == 0, F.col("url")).otherwise(made).alias("t"))
    return titles.select("page_id", tx.title_parts(F.col("t")).alias("x")).select("page_id", "x.*")


@query("q_clean_zone", r"select doc_id, i - 1 as ordinal, rtrim(regexp_replace(concat(' - ', line), '^[\s\-–—ـ]+', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as zone from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10)) as l from documents))")
def clean_zone(v: Views) -> DataFrame:
    lines = v.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), tx.cleaned_zone(F.concat(F.lit(" - "), F.col("line"))).alias("zone"))


_WINDOWED = "(select page_id, case when page_id % 3 = 0 then url else concat('خلال ', url, chr(10), ' 8:00-', cast(page_id % 12 as varchar), '، على مستوى المناطق التالية : ', html) end as t from pages)"


@query("q_time_window", f"select page_id, nullif(trim(regexp_extract(t, '{tx.TIME_WINDOW}', 1)), '') as sentence from {_WINDOWED}")
def time_window(v: Views) -> DataFrame:
    made = F.concat(F.lit("خلال "), "url", F.lit("\n 8:00-"), (F.col("page_id") % 12).cast("string"), F.lit("، على مستوى المناطق التالية : "), "html")
    return v.raw("pages").select("page_id", tx.time_window(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(made)).alias("sentence"))


_ITEMS = "list_filter(list_transform(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '')"


@query("q_raw_snapshot", f"""select page_id, sha256(case when page_id % 2 = 0 then html else concat('{{"notice_date": ', case when page_id % 5 = 0 then 'null' else '"01/07/2026"' end, ', "raw_text": ', to_json(html)::varchar, ', "subregions": [], "title": ', to_json(url)::varchar, ', "zones": [', array_to_string(list_transform({_ITEMS}, lambda x: to_json(x)::varchar), ', '), ']}}') end) as digest from pages""")
def raw_snapshot(v: Views) -> DataFrame:
    page = F.col("page_id")
    body = tx.raw_snapshot(F.when(page % 2 == 0, F.col("html")), F.col("url"), F.when(page % 5 != 0, "01/07/2026"), tx.list_items(F.col("html")), F.col("html"))
    return v.raw("pages").select("page_id", F.sha2(body, 256).alias("digest"))


@query("q_normalize_text", "select doc_id, md5(translate(regexp_replace(regexp_replace(trim(nfc_normalize(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+', ' ', 'g'), '[ؐ-ًؚ-ْٰۖ-ۭـ]', '', 'g'), 'أإآة', 'اااه')) as digest from documents")
def normalize_text(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", F.md5(tx.normalized(tx.composed(F.col("text")))).alias("digest"))


@query("q_posexplode", "select doc_id, count(*) as lines, max(i) - 1 as last from (select doc_id, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10)) as l from documents)) group by doc_id")
def posexplode(v: Views) -> DataFrame:
    lines = v.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("i").cast("long").alias("last"))


@query("q_flatten_zones", "select doc_id, cast(len(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')))) as bigint) as zones from documents")
def flatten_zones(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", F.size(F.flatten(F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")))).cast("long").alias("zones"))


@query("q_token_sort_key", "select p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') as key from part")
def token_sort_key(v: Views) -> DataFrame:
    return v.raw("part").select("p_partkey", tx.token_sort_key(F.col("p_name")).alias("key"))


@query("q_exact_canonical", "select p_partkey, first_value(p_name) over (partition by array_to_string(list_sort(string_split(p_name, ' ')), ' ') order by p_partkey) as canonical from part")
def exact_canonical(v: Views) -> DataFrame:
    keyed = v.raw("part").select("p_partkey", "p_name", tx.token_sort_key(F.col("p_name")).alias("key"))
    first = keyed.groupBy("key").agg(F.min_by("p_name", "p_partkey").alias("canonical"))
    return keyed.join(first, "key").select("p_partkey", "canonical")


_NORMAL = "translate(regexp_replace(regexp_replace(trim(nfc_normalize({}), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+', ' ', 'g'), '[ؐ-ًؚ-ْٰۖ-ۭـ]', '', 'g'), 'أإآة', 'اااه')"
#: names in order, linked by the Indel ratio of their sorted tokens (common subsequences by bits), decided one after the other
_CANONICAL = f"""n as (select p_name, min(p_partkey) as first, {_NORMAL.format('p_name')} as key from part where p_name is not null group by p_name),
k as materialized (select *, row_number() over (order by first) as id, length(t) as len, (1::hugeint << length(t)) - 1 as full_ from (select key, min(first) as first, arg_min(p_name, first) as raw, array_to_string(list_sort(string_split(trim(key), ' ')), ' ') as t from n group by key)),
c as materialized (select a.id as u, b.id as v, a.t as tu, b.t as tv, a.full_ as full_, a.len + b.len as both_ from k a join k b on a.id < b.id where levenshtein(a.t, b.t) <= 0.1 * (a.len + b.len) + 1e-9),
m as (select *, list_reduce(list_concat([full_], list_transform(string_split(tv, ''), lambda x: list_sum(list_transform(range(1, length(tu) + 1), lambda j: case when tu[j] = x then 1::hugeint << (j - 1) else 0::hugeint end))::hugeint)), lambda r, h: (((r + (r & h)) | (r - (r & h))) & full_)) as bits from c),
links as materialized (select u, v, score from (select u, v, 200.0::double * (length(tu) - bit_count(bits)) / both_ as score from m) where score >= 90),
near as (select v, list(u) as us, row_number() over (order by v) as s from links group by v),
decided(s, gone) as (select 0::bigint, []::bigint[] union all select near.s, case when len(list_filter(us, lambda x: not list_contains(gone, x))) > 0 then list_append(gone, near.v) else gone end from decided join near on near.s = decided.s + 1),
gone as (select unnest(arg_max(gone, s)) as id from decided),
ends as (select u, v, score from links union all select v, u, score from links),
chosen as (select n.p_name, arg_max(o.raw, {{'s': score, 'i': -o.id}}) as canonical from n join k on k.key = n.key join ends on ends.v = k.id join k o on o.id = ends.u where k.id in (select id from gone) and o.id not in (select id from gone) and o.first < n.first group by n.p_name)"""


@query("q_fuzzy_canonical", f"with recursive {_CANONICAL} select p_partkey, p.p_name, coalesce(chosen.canonical, k.raw) as canonical from part p join n on n.p_name = p.p_name join k on k.key = n.key left join chosen on chosen.p_name = p.p_name")
def fuzzy_canonical(v: Views) -> DataFrame:
    names = v.raw("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("first"))
    found = canonical_names(names).withColumnRenamed("name", "p_name")
    return v.raw("part").join(found, "p_name").select("p_partkey", "p_name", "canonical")


@query("q_date_normalize", "select notice_id, outage_date as iso from fx_parses")
def date_normalize(v: Views) -> DataFrame:
    """Dates written as dd/MM/yyyy, or as no date at all, and read back."""
    raw = F.coalesce(F.date_format(F.to_date("outage_date"), "dd/MM/yyyy"), F.lit("31/02/2026"))
    return v.parses.select("notice_id", tx.iso_date(raw).alias("iso"))


@query("q_governorate_key", "select governorate, translate(lower(governorate), 'éèê', 'eee') as key, count(*) as units from fx_units group by governorate")
def governorate_key(v: Views) -> DataFrame:
    return v.units.groupBy("governorate").agg(F.count("*").alias("units")).select("governorate", tx.governorate_key(F.col("governorate")).alias("key"), "units")


_DIMENSION = ", ".join(f"({i}, '{name}')" for i, (name, *_) in enumerate(GOVERNORATES))


@query("q_accented_keys", f"select regexp_replace(strip_accents(lower(name)), '\\s+', ' ', 'g') as key, count(*) as units, count(distinct c_nationkey) as nations from customer join (values {_DIMENSION}) d(g, name) on g = c_nationkey % {len(GOVERNORATES)} group by 1")
def accented_keys(v: Views) -> DataFrame:
    """Units by the key of their governorate's name as it is written, with accents, capitals and wide spaces."""
    named = v.raw("customer").withColumn("g", (F.col("c_nationkey") % len(GOVERNORATES)).cast("int")).join(F.broadcast(governorates(v.spark)), "g")  # the fixed dimension
    written = F.concat(F.lit("  "), F.replace(F.when(F.col("c_custkey") % 2 == 0, F.upper("name")).otherwise(F.col("name")), F.lit(" "), F.lit("   ")), F.lit(" "))
    return named.groupBy(tx.governorate_key(written).alias("key")).agg(F.count("*").alias("units"), F.countDistinct("c_nationkey").alias("nations"))


@query("q_stable_ids", "select unit_id, substr(sha256(concat('region', '|', governorate, '|unit|', cast(unit_id as varchar))), 1, 16) as stable_id from fx_units")
def stable_ids(v: Views) -> DataFrame:
    text = F.concat_ws("|", F.lit("region"), "governorate", F.lit("unit"), F.col("unit_id").cast("string"))
    return v.units.select("unit_id", F.substring(F.sha2(text, 256), 1, 16).alias("stable_id"))
