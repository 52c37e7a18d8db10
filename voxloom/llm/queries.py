"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.texts import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.tokens import token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, _tokenizer("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.secrets import digest, secret_spans

    return digest(secret_spans(_table(spark, sf_dir, "documents")))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.simhash import hex_fingerprint, simhash_groups

    found = simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, bits=64, distance=2, width=32)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.language import fold_of, identify, labelled_sample

    docs = _table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 4) == 2
    sample = labelled_sample(docs.where(~F.coalesce(held, F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), sample).select("doc_id", "held_out", "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.language import fold_of
    from voxloom.llm.ppm import scores

    return scores(_table(spark, sf_dir, "documents"), fold_of("doc_id", 10) == 0)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.embeddings import embedding_links

    found = embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.withColumn("component_id", F.col("component_id").cast("bigint"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=20)


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), least=0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.language import fold_of
    from voxloom.llm.manifest import manifest

    tampered = F.when(fold_of("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(_table(spark, sf_dir, "documents"), tampered)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxloom.llm.bytespans import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_token_counts, op3_embedding_dedup, op4_best_fit_packing, op5_secret_scan, op6_substring_dedup, op7_warc_zip, op8_language_id, op9_lm_score, op10_decontaminate,
        op11_filter_audit, op12_merkle_manifest, op13_suffix_array_dedup,
    )
}
SQL: dict[str, str] = {
    "op3_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n as (select *, sqrt(list_dot_product(e, e)) m from v),
        links as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.98),
        reach(node, cur) as (select vec_id, vec_id from embeddings union select r.node, l.b from reach r join links l on r.cur = l.a),
        roots as (select node, min(cur) root from reach group by node), counts as (select a, count(*) c from links group by a)
        select e.vec_id, coalesce(c, 0)::bigint n_links, root component_id, e.vec_id = root kept from embeddings e join roots on node = e.vec_id left join counts on a = e.vec_id""",
    "op6_substring_dedup": """
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+') w from documents),
        win as (select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') s from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
        firsts as (select s, min((doc_id, i)) f from win group by s),
        late as (select doc_id, i from win join firsts using (s) where (doc_id, i) > f),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) k from late),
        words as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) k from d),
        left_over as (select doc_id, count(*) filter (g.k is not null) n_removed, string_agg(x, ' ' order by words.k) filter (g.k is null) kept from words left join gone g using (doc_id, k) group by doc_id)
        select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join left_over using (doc_id)""",
    "op7_warc_zip": """
        with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages), t as (select h, max(page_id) top from p group by h),
        c as (select page_id, i, ('0x' || substr(x, 1 + 5 * i, 5))::bigint q from (select page_id, x, unnest(range(8)) i from p)),
        b as (select page_id, string_agg(substr(a, 1 + (q >> 15)::int, 1) || substr(a, 1 + ((q >> 10) & 31)::int, 1) || substr(a, 1 + ((q >> 5) & 31)::int, 1) || substr(a, 1 + (q & 31)::int, 1), '' order by i) digest
            from c, (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' a) group by page_id)
        select page_id, octet_length(encode(h))::bigint payload_bytes, digest payload_digest, case when page_id = top then 'response' else 'revisit' end record_type, case when page_id <> top then top end refers_to
        from p join t using (h) join b using (page_id)""",
    "op11_filter_audit": """
        with recursive t as (select doc_id, coalesce(source, '') part, coalesce(text, '') x, min(doc_id) over (partition by coalesce(text, '')) f from documents),
        w as (select *, regexp_extract_all(x, '[^ \\t\\n\\x0b\\x0c\\r]+') w from t),
        l as (select doc_id, max(quality) filter (quality = 1) good, max(toxic) filter (toxic = 1) toxic from labels group by doc_id),
        d as (select part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x))::int
            + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > f, false)::int m, coalesce(good, 0) good, coalesce(toxic, 0) toxic from w left join l on w.doc_id = l.doc_id),
        c as (select part, m, count(*) n, sum(good) g, sum(toxic) x from d group by all),
        f as (select unnest(range(5)) i), p(o, used, k) as (select '', 0, 0 union all select o || substr('ABCDE', i::int + 1, 1), used | (1 << i::int), k + 1 from p, f where k < 5 and used & (1 << i::int) = 0),
        s as (select a.o filter_order, k step, b.used & ~(1 << (ascii(substr(a.o, k, 1)) - 65)) was, 1 << (ascii(substr(a.o, k, 1)) - 65) bit from (select o from p where k = 5) a join p b on b.k > 0 and b.o = substr(a.o, 1, b.k)),
        r as (select part, filter_order, step, bit, sum(case when m & (was | bit) = 0 then n else 0 end)::bigint kept, sum(case when m & was = 0 and m & bit > 0 then n else 0 end)::bigint removed,
            sum(case when m & was > 0 and m & bit > 0 then n else 0 end)::bigint redundant, sum(case when m = bit then n else 0 end)::bigint unique_fails,
            sum(case when m & was = 0 and m & bit > 0 then g else 0 end)::bigint good_lost, sum(case when m & was = 0 and m & bit > 0 then x else 0 end)::bigint toxic_lost from c, s group by all)
        select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint shapley from r""",
    "op12_merkle_manifest": """
        with recursive u as (select *, case when list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))) % 2 = 1 then replace(text, chr(10), '') else text end received from documents),
        v as (select doc_id, source, received is distinct from text changed, received, text, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id::varchar, '-') || coalesce(octet_length(encode(source::varchar)) || ':' || source::varchar, '-') || coalesce(octet_length(encode(lang::varchar)) || ':' || lang::varchar, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars::varchar, '-') head from u),
        w as (select doc_id, source, sha256(head || coalesce(octet_length(encode(text::varchar)) || ':' || text::varchar, '-')) leaf, sha256(head || coalesce(octet_length(encode(received::varchar)) || ':' || received::varchar, '-')) told from v),
        lf as (select *, row_number() over (order by source nulls first, doc_id nulls first, leaf) r, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 p, count(*) over (partition by source) n from w),
        tr(g, lvl, i, m, h) as (select source, 0, p, n, leaf from lf union all select g, lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(h, '' order by i)) from tr where m > 1 group by g, lvl, i // 3, m),
        sub as (select g, lvl height, h, row_number() over (order by g nulls first) - 1 j, count(*) over () n from tr where m = 1),
        tp(lvl, i, m, h) as (select 0, j, n, h from sub union all select lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(h, '' order by i)) from tp where m > 1 group by lvl, i // 3, m),
        own as (select r, p, source, leaf, told, height, j, sub.h subroot from lf join sub on source is not distinct from g),
        steps as (select r, lvl k, coalesce(string_agg(h, '' order by i) filter (i < p // (3 ** lvl)::bigint), '') a, coalesce(string_agg(h, '' order by i) filter (i > p // (3 ** lvl)::bigint), '') b
            from own join tr on g is not distinct from source and m > 1 and i // 3 = p // (3 ** (lvl + 1))::bigint group by r, lvl
            union all select r, height + lvl, coalesce(string_agg(h, '' order by i) filter (i < j // (3 ** lvl)::bigint), ''), coalesce(string_agg(h, '' order by i) filter (i > j // (3 ** lvl)::bigint), '')
            from own join tp on m > 1 and i // 3 = j // (3 ** (lvl + 1))::bigint group by r, height, lvl),
        proofs as (select r, sha256(string_agg(a || b, '' order by k)) x from steps group by r),
        folds(r, k, h) as (select r, 0, told from own union all select folds.r, folds.k + 1, sha256(a || h || b) from folds join steps on folds.r = steps.r and folds.k = steps.k),
        ends as (select r, max_by(h, k) h from folds group by r)
        select doc_id, lf.leaf, subroot, t.h root, coalesce(x, sha256('')) proof_sha256, ends.h folded_root, ends.h = t.h verified
        from lf join own using (r) join ends using (r) left join proofs using (r), (select h from tp where m = 1) t""",
    "op13_suffix_array_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) b from documents), h as (select doc_id, hex(b) x, octet_length(b) n, row_number() over () r from d),
        cut as (select r, o, n, substr(x, 1 + 2 * o::int, 2398) y from (select r, x, n, unnest(range(0, n, 1000)) o from h)),
        win as (select r, o + i i, md5_number(substr(y, 1 + 2 * i::int, 400)) s from (select r, o, y, unnest(range(least(1000, n - 199 - o))) i from cut where n - 199 > o)),
        twice as (select s from win group by s having count(*) > 1),
        gone as (select distinct r, unnest(range(i, i + 200)) k from win semi join twice using (s)),
        kept as (select r, k, y from (select r, o + k k, substr(y, 1 + 2 * k::int, 2) y from (select r, o, y, unnest(range(least(1000, n - o))) k from cut)) anti join gone using (r, k)),
        left_over as (select r, string_agg(y, '' order by k) y from kept group by r),
        spans as (select r, count(*) n_removed, count(*) filter (g.k - 1 <> coalesce(p, -2)) n_spans from (select r, k, lag(k) over (partition by r order by k) p from gone) g group by r)
        select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(y, ''))) kept_sha256 from h left join left_over using (r) left join spans using (r)""",
}
