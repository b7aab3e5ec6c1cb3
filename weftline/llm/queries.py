"""The thin queries op1 to op13, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import materialize, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import quality

    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op1_sql() -> str:
    from weftline.llm import quality as q

    rate, rules = q.ALPHA / len(q.RULES), q.RULES
    measures = ", ".join(f"case when n_words > 0 then {sign} * cast({top} as double) / {bottom} end as m_{r}" for r, ((top, sign, bottom), _) in rules.items())
    tests = " union all ".join(
        f"select stratum, '{r}' as rule, {i} as place, cast({c} as double) as c, count(*) as n, count(*) filter (m_{r} > {c}) as k from good group by stratum" for r, (_, cs) in rules.items() for i, c in enumerate(cs)
    )
    fails = " or ".join(f"coalesce(m_{r} > (select c from cutoff x where x.stratum = m.stratum and x.rule = '{r}'), false)" for r in rules)
    return rf"""
with t as (select row_number() over () as row, doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select row, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as l,
   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals, length(regexp_replace(text, '[ 	-
]+', '', 'g')) as word_chars from t),
g as (select row, i, array_to_string(w[i:i + 4], ' ') as g from (select row, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
d as (select row, i from (select row, i, count(*) over (partition by row, g) as c from g) where c > 1),
r as (select row, sum(least(5, coalesce(next - i, 5))) as n from (select row, i, lead(i) over (partition by row order by i) as next from d) group by row),
f as (select t.row, doc_id, stratum, cast(len(w) as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
   cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(l) as n_lines, n_capitals from t join w on t.row = w.row left join r on r.row = t.row),
m as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, {measures} from f),
labelled as (select m.* from m join (select doc_id from labels where quality is not null group by doc_id having max(quality) = 1) using (doc_id)),
good as (select * from labelled where not base_failed),
tests as ({tests}),
tried as (select *, case when k > n * {rate!r} then 1.0 else (select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r}))) from range(0, k + 1) x(i)) end <= {q.DELTA!r} / ({len(rules)} * (select count(distinct stratum) from labelled)) as ok from tests),
cutoff as (select stratum, rule, max_by(c, place) as c from (select *, bool_and(ok) over (partition by stratum, rule order by place) as going from tried) where going group by stratum, rule)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({fails}) as kept from m"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import simhash

    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import pii

    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: lambda x: x["kind"] == kind
    by_kind = F.flatten(F.array(*[F.array_sort(F.filter(F.concat("base", "added"), of(k))) for k in pii.TAGGED]))
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(by_kind).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(by_kind).cast("long").alias("n_spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import licenses

    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.flatten("places")
    phrase = F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(licenses.PHRASES)]), lambda x: x.isNotNull())
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        text(phrase).alias("base_labels"), text(F.concat(phrase, F.transform("spans", lambda x: x["label"]))).alias("labels"), F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import toxicity
    from weftline.llm.language import held_out

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language.fit(docs.filter(~language.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = language.identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import brown
    from weftline.llm.language import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id"), 7).alias("held"), "text")
    return brown.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import repeats

    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import mixing

    mixed = materialize(mixing.mixed_documents(table(spark, sf_dir, "documents")), "mixed")
    sources = materialize(mixing.source_table(mixed).withColumnRenamed("source", "s"), "sources")
    out = mixed.join(sources, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", F.col("__wl_size").alias("size"), "source_size", "target", (F.col("__wl_size") * F.col("__wl_copies")).alias("taken"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import decontaminate

    return decontaminate.contaminations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import infill

    made = infill.infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.original(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_OP11_SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256(concat('1:', coalesce(cast(doc_id as varchar), ''))) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as w, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(w[:a], ''), '') as pre, coalesce(array_to_string(w[a + 1:b], ''), '') as mid, coalesce(array_to_string(w[b + 1:], ''), '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', pre, '<S>', suf, '<M>', mid) else concat('<S>', suf, '<P>', pre, '<M>', mid) end) as output_sha256, sha256(text) as restored_sha256 from p"""


OLD_SHARDS, NEW_SHARDS = 12, 16


def op12_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by source, as ingestion left them, to 16 of nearly equal bytes."""
    from weftline.llm import shards

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", shards.text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), shards.old_shard(F.col("source"), OLD_SHARDS).alias("old_shard"))
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "size", "text_crc32"))
    placed, _ = shards.layout(rows, "old_shard", "size", ["__h", "doc_id", "text_crc32"], NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import turns

    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turns.digests(turns.damaged(conversations)).withColumnRenamed("conv_id", "__id")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.select("conv_id", *[x.alias(c) for c, x in none.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op13_sql() -> str:
    """Costs, audits and lines of each state, from the last row to the first; the least of each by cost, then audit."""
    fitting = (3, 3, 4, 3)  # places in the list of states
    kept = {1: "case initial when 's' then 2 when 'u' then 3 end", 2: "case initial when 'u' then 3 end", 3: "case initial when 'a' then 4 end", 4: "case initial when 'u' then 3 end"}
    made = {3: "user:", 4: "assistant:"}
    item = lambda cost, letter, lines, v: f"{{'c': {cost} + ({v}).c, 'a': '{letter}' || ({v}).a, 'r': list_concat({lines}, ({v}).r)}}"
    row, put = [], []
    for q, to in zip(range(1, 5), fitting):
        delete, keep, rerole = item(3, "D", "[]::varchar[]", f"v[{q}]"), item("cut", "K", "[line]", f"v[{kept[q]}]"), item("2 + cut", "R", f"['{made[to]}' || text]", f"v[{to}]")
        row.append(f"list_min([{delete}, case when not gone and ({kept[q]}) is not null then {keep} end, case when not gone then {rerole} end])")
        then = fitting[to - 1]
        one, two = item(2, "I", f"['{made[to]}']", f"w[{to}]"), item(4, "II", f"['{made[to]}', '{made[then]}']", f"w[{then}]")
        put.append(f"list_min([w[{q}], {one}, {two}])")
    return rf"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as key from conversations),
c as (select k.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 as case_ from k cross join crc),
d as (select conv_id, turn, case when case_ = 4 then 'user' else role end as role, case case_ when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when case_ = 3 then 2 else 1 end)) as copy from c where case_ <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body, substr(role, 1, 1) as initial from d),
f as (select *, body = '' as blank, body <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate, lag(initial) over (partition by conv_id order by i) as before from o),
r as materialized (select *, blank or duplicate as gone, not blank and not duplicate and right(body, 1) not in ('.', '!', '?') as truncated, cast(not blank and not duplicate and right(body, 1) not in ('.', '!', '?') as int) as cut, role || ':' || text as line from f),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
s(conv_id, i, v) as (
  select conv_id, n + 1, [{{'c': 0, 'a': '', 'r': []::varchar[]}}, {{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::varchar[]}}] from n
  union all
  select conv_id, i, [{', '.join(put)}] from (select s.conv_id, r.i, [{', '.join(row)}] as w from s join r on r.conv_id is not distinct from s.conv_id and r.i = s.i - 1)),
e as (select conv_id, cast(v[1].c as bigint) as cost, v[1].a as audit, sha256(array_to_string(v[1].r, chr(10))) as repaired_sha256 from s where i = 1)
select x.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) x left join n on n.conv_id is not distinct from x.conv_id left join e on e.conv_id is not distinct from x.conv_id"""


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_licenses that SQL can state."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _license_sql() -> str:
    from weftline.llm import licenses

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = lambda phrase: " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
    places = [f"list_filter(range(len(w)), lambda i: {at(phrase)})" for phrase, _ in licenses.PHRASES]
    found = ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, (_, label) in enumerate(licenses.PHRASES))
    every = "flatten([" + ", ".join(f"p{i}" for i in range(len(places))) + "])"
    return rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, {', '.join(f'{x} as p{i}' for i, x in enumerate(places))} from t)
select doc_id, cast(len(w) as bigint) as n_words, cast(len({every}) as bigint) as n_base, list_min({every}) as first_word, list_max({every}) as last_word, array_to_string(list_sort(list_distinct(list_filter([{found}], lambda x: x is not null))), ',') as base_labels from p"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, source_size, target) of op10_mixing."""
    from weftline.llm import mixing

    docs = table(spark, sf_dir, "documents").select(mixing.word_count(F.col("text")).alias("__wl_size"), F.array("source").alias("__wl_pattern"))
    found = mixing.target_table(mixing.source_sizes(materialize(docs, "sizes")))
    return found.select("source", F.col("size").alias("source_size"), F.round("target", 6).alias("target"))


_MIX_SQL = r"""
with recursive t as (select source, cast(coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0) as bigint) as size from documents group by source),
o as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from t),
s as (select list({'n': size, 'w': weight}) as of, sum(size)::double as total from o),
r(k, level) as (select 0, total / list_sum(list_transform(of, lambda x: x.w)) from s union all
  select k + 1, (total - coalesce(list_sum(list_transform(list_filter(of, lambda x: level * x.w > 3 * x.n), lambda x: 3 * x.n)), 0)) / list_sum(list_transform(list_filter(of, lambda x: level * x.w <= 3 * x.n), lambda x: x.w)) from r cross join s where k < 60 and len(list_filter(of, lambda x: level * x.w <= 3 * x.n)) > 0)
select source, size as source_size, round(case when level * weight > 3 * size then cast(3 * size as double) else level * weight end, 6) as target from o cross join (select level from r order by k desc limit 1)"""


QUERIES = {"op1_quality": op1_quality, "op5_decontamination": op5_decontamination, "op10_mixing": op10_mixing, "op2_pii": op2_pii, "op3_licenses": op3_licenses, "op4_toxicity": op4_toxicity, "op6_language": op6_language, "op7_brown": op7_brown, "op8_suffix_repeats": op8_suffix_repeats, "op9_simhash": op9_simhash, "op11_infill": op11_infill, "op12_resharding": op12_resharding, "op13_turns": op13_turns, "license_places": license_places, "mix_targets": mix_targets}
ORACLE_SQL: dict[str, str] = {"op1_quality": _op1_sql(), "op11_infill": _OP11_SQL, "op13_turns": _op13_sql(), "license_places": _license_sql(), "mix_targets": _MIX_SQL}
