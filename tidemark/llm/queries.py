"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, decontam, langid, mixing, oddsketch, pii, repair, simhash, spelling, substring, toxicity, url_filter

#: The rules of the url query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.fit(docs.where(~held_out(F.col("doc_id"))), labels)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.predict(docs.drop("lang"), model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    formatted = chat.conversations(chat.linear(turns.unionByName(extra)))
    return chat.digest(formatted.withColumnRenamed("tree", "conv_id"), ["conv_id"])


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_recurring(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.digest(turns, *repair.repair(repair.damaged(turns)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filter, op3_toxicity, op4_language, op5_decontam, op6_chat, op7_ann, op8_simhash, op9_mixing, op10_substring, op11_repair, op12_spelling, op13_minhash, pipeline)}



def repair_sql() -> str:
    """Repairs from the end of each conversation: for each state the least of (cost, audit, repaired lines) by a recursion over its rows."""
    chosen, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda q: q is not null))"
    add = lambda cost, edit, line, v: f"case when {v} is not null then {{'c': {v}.c + {cost}, 'a': '{edit}' || {v}.a, 't': {line} || {v}.t}} end"

    def relaxed(a: str, b: str) -> str:
        """Values b of values a by at most one insert."""
        return ", ".join(least(f"{a}{s}", add(2, "I", f"'{names[chosen[s]]}:' || chr(10)", f"{a}{chosen[s]}")) + f" as {b}{s}" for s in range(4))

    def taken(s: int) -> str:
        keep = " ".join(f"when initial = '{x}' then {add('cut', 'K', 'role || chr(58) || text || chr(10)', f'v{t}')}" for x, t in kept[s].items())
        keep = f"case when gone then null when initial = '' then {add('cut', 'K', 'role || chr(58) || text || chr(10)', f'v{s}')} {keep} end"
        reroled = add("2 + cut", "R", f"'{names[chosen[s]]}:' || text || chr(10)", f"v{chosen[s]}")
        return least(add(3, "D", "''", f"v{s}"), keep, f"case when not gone then {reroled} end") + f" as x{s}"

    state = ", ".join(f"z{s} as v{s}" for s in range(4))
    end = "{'c': 0::bigint, 'a': '', 't': ''}"
    none = "null::struct(c bigint, a varchar, t varchar)"
    inside = lambda source: f"(select key, i, {relaxed('y', 'z')} from (select key, i, {relaxed('x', 'y')} from ({source})))"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
own as (select coalesce('=' || conv_id, '') as key, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
kind as (select key, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || h[2 * i + 1 : 2 * i + 2])::bigint for i in range(length(h) // 2)]), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 as k from own, tab),
harm as (select key, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy from kind where k <> 0),
line as (select *, row_number() over (partition by key order by turn nulls first, role, text, copy) as i, count(*) over (partition by key) as n, row_number() over (partition by key, role, text order by turn nulls first, copy) as again, rtrim(text, {spaces}) as bare, role[1:1] as initial from harm),
row_ as (select *, bare = '' as blank, bare <> '' and again > 1 as twice, bare <> '' and again = 1 and right(bare, 1) not in ('.', '!', '?') as short_, bare = '' or again > 1 as gone, (bare <> '' and again = 1 and right(bare, 1) not in ('.', '!', '?'))::int as cut, lag(initial) over (partition by key order by i) as was from line),
best as (select key, i, {state} from {inside(f"select key, max(n) + 1 as i, {end} as x0, {none} as x1, {none} as x2, {end} as x3 from row_ group by key")}
union all select key, i, {state} from {inside(f"select b.key, r.i, {', '.join(taken(s) for s in range(4))} from best b join row_ r on r.key = b.key and r.i = b.i - 1")}),
count_ as (select key, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (twice) as duplicate, count(*) filter (short_) as truncated, count(*) filter (i > 1 and was || initial not in ('su', 'ua', 'au')) as illegal from row_ group by key)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(v0.c, 0)::bigint as cost, coalesce(v0.a, '') as audit,
sha256(case when coalesce(v0.t, '') = '' then '' else v0.t[1 : length(v0.t) - 1] end) as repaired_sha256
from (select distinct conv_id, coalesce('=' || conv_id, '') as key from conversations) c left join count_ using (key) left join best on best.key = c.key and best.i = 1"""


SQL = {
    "op11_repair": repair_sql(),
    "op5_decontam": r"""
with doc as (select doc_id, row_number() over () as rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
item as (select cast(item_id as varchar) as item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark where item_id is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from item where len(w) > 0)),
lens as (select distinct n from win),
grams as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lens where len(w) >= n)),
found as (select rid, i, g.n, item_id from grams g join win using (n, phrase)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from found)) group by rid),
ids as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as said from (select distinct rid, item_id from found) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(said, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (rid) left join ids using (rid)""",
    "op6_chat": r"""
with t as (select conv_id, turn, role, text from conversations union all select -1, x, case x when 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) r(x)),
s as (select conv_id, turn, role as r0, text as t0, coalesce(role, '') as role, coalesce(text, '') as text from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::bigint as formatted_chars
from s group by conv_id""",
    "op10_substring": r"""
with doc as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select rid, i, md5(array_to_string(w[i : i + 34], ' ')) as h from (select rid, w, unnest(range(1, len(w) - 33)) as i from doc where len(w) >= 35)),
twice as (select h from win group by h having count(*) > 1),
gone as (select distinct rid, p from (select rid, unnest(range(i, i + 35)) as p from win semi join twice using (h))),
word as (select rid, p, w[p] as x from (select rid, w, unnest(range(1, len(w) + 1)) as p from doc)),
kept as (select rid, string_agg(x, ' ' order by p) as said from word anti join gone using (rid, p) group by rid),
n as (select rid, count(*) as n_removed from gone group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(said, '')) as kept_sha256
from doc left join n using (rid) left join kept using (rid)""",
    "op12_spelling": r"""
with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
run as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents) where length(run) >= 7 group by all),
code as (select run, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from run),
sum_ as (select run, c, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || h[2 * i + 1 : 2 * i + 2])::bigint for i in range(length(h) // 2)]), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as k from code, tab),
word as (select w as word, sum(c)::bigint as n from (select c, case when k % 31 = 0 then run[1 : k % length(run)] || run[k % length(run) + 2 :] else run end as w from sum_) where length(w) >= 7 group by w having sum(c) >= 2),
plain as (select *, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') as p from word),
near as (select a.word, a.n, b.word as other, b.n as other_n from plain a join plain b on abs(length(a.p) - length(b.p)) <= 1 and levenshtein(a.p, b.p) = 1),
best as (select word, any_value(n) as n, count(*) as n_near, min_by({'o': other, 'n': other_n}, (-other_n, other)) as b from near group by word),
form as (select word, n_near, case when b.n >= 10 * n then b.o end as form, case when b.n >= 10 * n then b.n end as form_n from best),
chain as (select word, form as at_ from form where form is not null union all select chain.word, form.form from chain join form on form.word = chain.at_ where form.form is not null),
root as (select chain.word, chain.at_ as root from chain left join form on form.word = chain.at_ where form.form is null)
select word, form, coalesce(root, word) as root, n, coalesce(n_near, 0)::bigint as n_near, form_n from word left join form using (word) left join root using (word)""",
    "op13_minhash": r"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct rid, array_to_string(w[i : i + 2], ' ') as x from (select rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
own as (select rid, count(*) as n, md5(string_agg(x, chr(10) order by x)) as h from s group by rid),
rep as (select h, min(rid) as r, any_value(n) as n from own group by h),
rs as (select rep.r, s.x from rep join s on s.rid = rep.r),
pair as (select a.r as p, b.r as q, count(*) as both_ from rs a join rs b on a.x = b.x and a.r < b.r group by all),
link as (select p, q from pair join rep a on a.r = p join rep b on b.r = q where 100 * both_ >= 85 * (a.n + b.n - both_)),
edge as (select p, q from link union all select q, p from link),
reach as (select r as p, r as q from rep union select reach.p, edge.q from reach join edge on edge.p = reach.q),
least as (select reach.p as r, min(d.doc_id) as c from reach join rep on rep.r = reach.q join own on own.h = rep.h join d on d.rid = own.rid group by reach.p)
select doc_id, coalesce(own.n, 0)::bigint as n_shingles, case when own.n is null then doc_id else c end as component_id, coalesce(doc_id = case when own.n is null then doc_id else c end, false) as kept
from d left join own using (rid) left join rep using (h) left join least on least.r = rep.r""",
}
