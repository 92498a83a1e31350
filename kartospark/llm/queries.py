"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartospark.llm import decontaminate, fill_middle, language, line_dedup, lm, mixing, packing, quality_model, quality_rules, secrets, sharding, simhash, spelling
from kartospark.llm.common import crc32_mod, table
from kartospark.sources.shared import shared_dir


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is stored in the shared folder: round robin as version 0, rebalanced by bytes as version 1."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16, map_path=f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rejected_by")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (crc32_mod("doc_id", 4) != 2)).select("doc_id")
    found = quality_model.scored(table(spark, sf_dir, "documents"), trusted)
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights by labelled quality: 2 for good, 0.5 for poor documents."""
    best = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), quality=label_weights(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc32_mod("doc_id", 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scored(docs, remainder != 0).withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(crc32_mod("doc_id", 3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.by_document(docs)
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.array_join(F.col("kept").cast("array<string>"), ",").cast("binary"), 256).alias("kept_sha256"))


def op10_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "n_near")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), slip=spelling.SLIP)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.transformed(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_groups": op1_simhash_groups,
    "op2_slot_shards": op2_slot_shards,
    "op3_linked_secrets": op3_linked_secrets,
    "op4_rule_cascade": op4_rule_cascade,
    "op5_pu_quality": op5_pu_quality,
    "op6_source_mix": op6_source_mix,
    "op7_gru_scores": op7_gru_scores,
    "op8_language_spans": op8_language_spans,
    "op9_line_dedup": op9_line_dedup,
    "op10_benchmark_passages": op10_benchmark_passages,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_middle": op12_fill_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_WORD = r"[^\x20\x09-\x0D]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _secret_sql() -> str:
    """Spans by kind as in ``secrets.found``; links by a plain join on distance."""
    kinds = {**secrets.BASE, **secrets.WEAK}
    found = " union all ".join(
        f"select r, {i} k, {least} least, regexp_extract_all(text, '{p}') ms, regexp_extract_all(text, '{p}', {g}) gs, string_split_regex(text, '{p}') ps from d"
        for i, (p, least, g) in enumerate((rx.replace("'", "''"), n, g) for rx, n, g in kinds.values())
    )
    number = {k: i for i, k in enumerate(secrets.KINDS)}
    ids, keys = (", ".join(str(number[k]) for k in ks) for ks in (secrets.IDENTIFIERS, secrets.SECRETS))

    def near(ks: str) -> str:
        return f"exists (select 1 from s o where o.r = s.r and o.k in ({ks}) and (o.e <= s.b and s.b - o.e <= {secrets.SCOPE} or o.b >= s.e and o.b - s.e <= {secrets.SCOPE}))"

    def text(rows: str) -> str:
        return f"coalesce(string_agg(n || ':' || b || ':' || e, ',' order by b, k) filter (where {rows}), '')"

    return f"""
        with d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
        f as ({found}),
        u as (select *, unnest(range(1, len(ms) + 1)) i from f where len(ms) > 0),
        s as (select r, k, b::bigint b, (b + length(ms[i]))::bigint e, {list(secrets.KINDS)}[k + 1] n from (
                select *, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) b
                from u where length(gs[i]) >= least)),
        t as (select * from s where k < {len(secrets.BASE)} or k = {number["login"]} and {near(keys)} or k = {number["opaque"]} and {near(ids)}
                or k = {number["endpoint"]} and {near(keys)} and {near(ids)})
        select doc_id, count(t.r) filter (where k = 0) n_assign, count(t.r) filter (where k = 1) n_access, count(t.r) filter (where k = 2) n_hex,
          sha256({text(f"k < {len(secrets.BASE)}")}) base_sha256, {text("k is not null")} spans
        from d left join t using (r) group by r, doc_id"""


def _spelling_sql() -> str:
    """Counts with crc32 by its table, one byte of UTF-8 after the other; near words meet by what a lost letter leaves, without keys."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    crc = "xor(list_reduce(list_transform(range(1, length(hex(encode(s))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295::bigint)"
    return rf"""
        with recursive d as (select coalesce(doc_id::varchar, '') id, {_FOLDED} text from documents),
        runs as (select id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) run from d),
        by_doc as (select id, run, count(*) times, id || ':' || run s from runs group by id, run),
        tab as (select {table} t),
        hashed as (select run, times, {crc} h from by_doc, tab),
        spelt as (select case when h % {spelling.SLIP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word, times from hashed),
        v as materialized (select word, sum(times)::bigint n from spelt where length(word) >= {spelling.LEAST_LENGTH} group by word having sum(times) >= {spelling.LEAST_COUNT}),
        gone as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select word, n, unnest(range(1, length(word) + 1)) i from v)),
        near as (
          select a.word, b.word other, b.n m from gone a join gone b on a.rest = b.rest and a.i = b.i and a.word <> b.word
          union select g.word, v.word, v.n from gone g join v on g.rest = v.word
          union select v.word, g.word, g.n from gone g join v on g.rest = v.word),
        best as (select word, count(*) n_near, min({{'m': -m, 'w': other}}) b from near group by word),
        f as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint n_near, case when -b.m >= {spelling.RATIO} * v.n then b.w end form, case when -b.m >= {spelling.RATIO} * v.n then -b.m end form_n from v left join best using (word)),
        chain as (select word, word root, form ahead from f union all select c.word, f.word, f.form from chain c join f on f.word = c.ahead)
        select f.word, f.form, root, n, n_near, form_n::bigint form_n from f join chain on f.word = chain.word and ahead is null"""


ORACLES: dict[str, str] = {
    "op3_linked_secrets": _secret_sql(),
    "op4_rule_cascade": rf"""
        with d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
        w as (select *, regexp_extract_all(text, '{_WORD}') ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
        pos as (select r, ws, unnest(range(1, len(ws) - 3)) p from w),
        g as (select r, p, array_to_string(ws[p:p + 4], ' ') g from pos),
        twice as (select r, p, count(*) over (partition by r, g) n from g),
        cov as (select r, count(distinct p + o) n from twice, (select unnest(range(0, 5)) o) where n > 1 group by r),
        m as (select w.*, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
                (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words,
                length(regexp_replace(text, '[^A-Z]', '', 'g')) upper_n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) letter_n,
                length(regexp_replace(text, '[^!]', '', 'g')) bang_n,
                len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) echo_n,
                length(regexp_replace(text, '[^0-9]', '', 'g')) digit_n,
                len(list_filter(ls, lambda x: regexp_matches(x, '^(- |\* |•)'))) bullet_n,
                len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) trailing_n
              from w left join cov using (r)),
        v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          not base_failed and 10 * n_symbols <= n_words and 10 * upper_n <= 3 * letter_n and 10 * bang_n <= n_words
            and 10 * echo_n <= n_words and 2 * n_dup_lines <= len(ls) and word_chars between 2 * n_words and 20 * n_words
            and 2 * digit_n <= word_chars and 10 * bullet_n <= 9 * len(ls) and 10 * trailing_n <= 3 * len(ls) kept
        from v""",
    "op6_source_mix": rf"""
        with q as (select doc_id, case when max(quality) = 1 then 2.0::double else 0.5::double end w from labels where doc_id is not null and quality is not null group by doc_id),
        d as (select row_number() over () r, d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint size,
                -ln((('0x' || substr(md5(d.doc_id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / coalesce(w, 1.0::double) k
              from documents d left join q on d.doc_id = q.doc_id),
        s as (select source, sum(size)::bigint source_size from d group by source),
        a as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] w, 2 * source_size cap, row_number() over (order by source nulls last) rk from s),
        b as (select *, (sum(source_size) over ())::double * 1.5::double total,
                coalesce(sum(cap) over (order by cap::double / w, rk rows between unbounded preceding and 1 preceding), 0) before_cap,
                sum(w) over (order by cap::double / w, rk rows between current row and unbounded following) behind from a),
        c as (select *, cap * behind < w * (total - before_cap::double) is_full from b),
        e as (select *, coalesce(sum(case when is_full then cap end) over (), 0)::double spent, (sum(case when not is_full then w end) over ())::double sharing from c),
        t as (select source, source_size, case when is_full then cap::double else w * (total - spent) / sharing end target from e),
        u as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs from t),
        x as (select d.*, u.source_size, u.target, u.epochs, u.target - u.epochs * u.source_size rest,
                coalesce(sum(size) over (partition by d.source order by k, d.doc_id, r rows between unbounded preceding and 1 preceding), 0) upto
              from d join u on d.source is not distinct from u.source)
        select doc_id, size, source_size, target, (size * (epochs + case when size > 0 and upto::double + size / 2.0::double < rest then 1 else 0 end))::bigint taken, source from x""",
    "op10_benchmark_passages": rf"""
        with d as (select row_number() over () r, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
        i as (select item_id::varchar item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
        ip as (select item_id, ws, least(10, len(ws)) n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) p from i where len(ws) > 0),
        win as (select distinct item_id, n, array_to_string(ws[p:p + n - 1], ' ') g from ip),
        lens as (select distinct n from win),
        dp as (select r, n, ws, unnest(range(1, len(ws) - n + 2)) p from d, lens where len(ws) >= n),
        dg as (select r, n, p, array_to_string(ws[p:p + n - 1], ' ') g from dp),
        hit as (select r, p, win.n, item_id from dg join win on dg.n = win.n and dg.g = win.g),
        cov as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from hit) group by r),
        its as (select r, count(*) n_items, string_agg(item_id, ',' order by item_id) l from (select distinct r, item_id from hit) group by r),
        iw as (select row_number() over () wid, least(10, len(ws))::bigint n, ws[p:p + least(10, len(ws)) - 1] win from (select ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) p from i where len(ws) > 0)),
        cnt as (select w, count(*) c from (select unnest(ws) w from d) group by w),
        ww as (select wid, n, w, count(*) times from (select wid, n, unnest(win) w from iw) group by all),
        rk as (select ww.*, coalesce(sum(times) over (partition by wid order by coalesce(c, 0), w rows between unbounded preceding and 1 preceding), 0) earlier from ww left join cnt using (w)),
        wl as (select wid, n, list({{'w': w, 'times': times}}) terms from ww group by wid, n),
        dw as (select r, q, ws[q] w from (select r, ws, unnest(range(1, len(ws) + 1)) q from d)),
        cand as (select distinct dw.r, rk.wid, dw.q from dw join rk on dw.w = rk.w where earlier <= n // 10),
        str as (select r, wid, n, terms, ws[greatest(1, q - s):q - s + n + 4] part from (select cand.*, d.ws, wl.n, wl.terms, unnest(range(0, wl.n + 5)) s from cand join d using (r) join wl using (wid))),
        near as (select r, count(distinct wid) n_near from str
                 where list_sum(list_transform(terms, lambda x: least(x.times, len(list_filter(part, lambda y: y = x.w))))) >= n - n // 10 group by r)
        select doc_id, coalesce(len(ws), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
          sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0) n_near
        from d left join cov using (r) left join its using (r) left join near using (r)""",
    "op11_spelling_variants": _spelling_sql(),
    "op12_fill_middle": rf"""
        with d as (select doc_id, coalesce(text, '') text, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
        u as (select *, length(text)::bigint n, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2,
                ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from d),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) p, greatest(h1 % (n + 1), h2 % (n + 1)) q,
                case when text = '' or contains(text, '{fill_middle.PREFIX}') or contains(text, '{fill_middle.SUFFIX}') or contains(text, '{fill_middle.MIDDLE}')
                  or h3 % 100 >= {fill_middle.RATE} then 'plain' when h4 % 100 < {fill_middle.SPM_RATE} then 'spm' else 'psm' end form from u),
        o as (select *, '{fill_middle.PREFIX}' || substr(text, 1, p) a, '{fill_middle.SUFFIX}' || substr(text, q + 1) b, '{fill_middle.MIDDLE}' || substr(text, p + 1, q - p) c from c)
        select doc_id, n, form, case when form <> 'plain' then p end prefix_chars, case when form <> 'plain' then q - p end middle_chars,
          sha256(case form when 'plain' then text when 'psm' then a || b || c else b || a || c end) output_sha256, sha256(text) restored_sha256
        from o""",
}
