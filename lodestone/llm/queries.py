"""One query for each operator: production parameters, the whole table, the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import kept_dir, parts_of, table
from lodestone.llm import audio, bpe, exact_dedup, jaccard_join, language_id, mixing, packing, pii, substring_dedup, suffix_dedup, time_partitions, vector_codes, warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = bpe.decode_ids(ids, path, public_tokenizers.PATTERN)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    names, model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    found = language_id.identify(docs, names, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of audio made from every embedding, and the recordings that align with those whose id 20 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return audio.search(vectors.repartition(parts_of(vectors, 2048)), "vec_id", "embedding", audio.melody)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit decreasing of all documents into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    digests = {f"{c}_sha256": F.sha2(c, 256) for c in ("metadata", "conversion")}
    return found.withColumns(digests).drop("metadata", "conversion")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window that also starts in an earlier document are removed."""
    found = substring_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere are removed."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data and secrets replaced by surrogates."""
    found = pii.replace_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_entities", "entity_types", "text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every usable vector, with their errors."""
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def moment_of_click() -> Column:
    """The moment a click is filed under: most clicks' own time, an earlier one for some, the start of the week for others."""
    k = F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    earlier = F.col("ts") - F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))
    return F.when(k < 16, earlier).when(k > 111, F.trunc(F.to_date("ts"), "week").cast("timestamp_ntz")).otherwise(F.col("ts"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of clicks in adaptive time ranges: written for those that arrived before May 2024, then rewritten for all."""
    clicks = table(spark, sf_dir, "clicks")
    limit, folder = 1 + clicks.count() // 500, kept_dir(spark, "clicks")
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-05-01").cast("timestamp_ntz"), F.lit(False))
    order = ("arrived_at", "click_id")
    time_partitions.write(clicks.filter(early), folder, limit, moment_of_click(), F.lit(True), order, "click_id")
    return time_partitions.report(spark, folder, time_partitions.write(clicks, folder, limit, moment_of_click(), ~early, order, "click_id"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all words takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_media_columns": op4_media_columns,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_vector_codes": op11_vector_codes,
    "op12_time_partitions": op12_time_partitions,
    "op13_source_mix": op13_source_mix,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as o, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents),
        k as (select doc_id, n, first_value(doc_id) over w as keep_id, count(*) over (partition by n) as group_size
              from t window w as (partition by n order by length(o) desc, doc_id))
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from k
    """,
    "op6_ngram_jaccard_join": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
        s as (select distinct doc_id, array_to_string(list_slice(a, i, i + 4), ' ') as t from (select doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) as i from d where len(a) > 0)),
        n as (select doc_id, count(*) as n from s group by 1),
        k as (select x.doc_id as x, y.doc_id as y, count(*) as k from s x join s y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
        l as (select x, y from k join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
        e as (select x, y from l union all select y, x from l),
        r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) as component_id
        from d left join n on n.doc_id = d.doc_id left join (select x, min(y) as c from r group by 1) c on c.x = d.doc_id
    """,
    "op8_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as a from documents),
        w as (select doc_id, i, array_to_string(list_slice(a, i, i + 12), ' ') as t from (select doc_id, a, unnest(range(1, len(a) - 11)) as i from d where len(a) > 12)),
        f as (select t, min(doc_id) as f from w group by 1),
        g as (select doc_id, list(distinct k) as g from (select w.doc_id, unnest(range(i, i + 13)) as k from w join f on f.t = w.t and f.f < w.doc_id) group by 1)
        select d.doc_id, len(a) as n_words, coalesce(len(g), 0) as n_removed,
            sha256(array_to_string(case when g is null then a else list_filter(a, lambda x, i: not list_contains(g, i)) end, ' ')) as kept_sha256
        from d left join g on g.doc_id = d.doc_id
    """,
    "op11_vector_codes": r"""
        with v as (select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (select r, part, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding[part * (len(embedding) // 16) + 1 : (part + 1) * (len(embedding) // 16)]] as x
            from v, unnest(range(16)) as u(part)),
        c0 as (select part, r - 1 as e, x as c from p where r <= 64),
        a1 as (select r, p.part, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)]) * 64 + e) % 64 as e from p join c0 on c0.part = p.part group by 1, 2),
        s1 as (select a.part, a.e, k, cast(floor(sum(x[k + 1]) / count(*)) as bigint) as m from a1 a join p on p.r = a.r and p.part = a.part, unnest(range(len(x))) as u(k) group by 1, 2, 3),
        c1 as (select c0.part, c0.e, coalesce(m, c) as c from c0 left join (select part, e, list(m order by k) as m from s1 group by 1, 2) s on s.part = c0.part and s.e = c0.e),
        a2 as (select r, p.part, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)]) * 64 + e) % 64 as e from p join c1 on c1.part = p.part group by 1, 2),
        s2 as (select a.part, a.e, k, cast(floor(sum(x[k + 1]) / count(*)) as bigint) as m from a2 a join p on p.r = a.r and p.part = a.part, unnest(range(len(x))) as u(k) group by 1, 2, 3),
        c2 as (select c1.part, c1.e, coalesce(m, c) as c from c1 left join (select part, e, list(m order by k) as m from s2 group by 1, 2) s on s.part = c1.part and s.e = c1.e),
        a3 as (select r, p.part, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)]) * 64 + e) as m from p join c2 on c2.part = p.part group by 1, 2),
        f as (select r, string_agg(printf('%02x', cast(m % 64 as int)), '' order by part) as code, cast(sum(m // 64) as bigint) as error from a3 group by 1)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
            (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from c2) as codebooks_sha256
        from v join f on f.r = v.r
    """,
    "op13_source_mix": r"""
        with recursive d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
        s0 as (select source, sum(size) as source_size, count(*) as n from d group by 1),
        s1 as (select *, row_number() over (order by source nulls last) as sid from s0),
        s2 as (select *, [3, 1, 2][(sid - 1) % 3 + 1] as w, 1.5::double * (select sum(source_size) from s1) as t from s1),
        s3 as (select *, coalesce(sum(2 * source_size) over k, 0) as below, sum(w) over () - coalesce(sum(w) over k, 0) as rest from s2
            window k as (order by 2.0 * source_size / w, sid rows between unbounded preceding and 1 preceding)),
        s4 as (select max((t - below)::double / rest) as level from s3),
        s5 as (select sid, source, source_size, n, t, least(2.0 * source_size, level * w)::double as target,
            ceil(sqrt(n)) as wanted from s2, s4),
        k1 as (select sid, row_number() over (order by target / (2 * i + 1) desc, sid, i) as place, t from
            (select *, unnest(range(cast(ceil(target / 4) + (select count(*) from s1) as bigint))) as i from s5 where target > 0)),
        q1 as (select sid, count(*) as quota from k1 where place <= floor(t / 4 + 0.5) group by 1),
        e as (select d.r, doc_id, size, d.source, source_size, target, s5.sid, wanted,
            cast(('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(cast(doc_id as varchar), '-'), size)), 1, 12)) as bigint) as u from d join s5 on s5.source is not distinct from d.source),
        l as (select *, cast(floor(cast(u as double) * wanted / 281474976710656.0) as int) as shard from e),
        o as (select *, coalesce(sum(size) over (partition by sid, shard order by u, doc_id nulls first, size, r rows between unbounded preceding and 1 preceding), 0) as at_ from l),
        h as (select sid, source, shard, sum(size) as shard_size, ceil(sum(size) / 4.0) as nb from o group by 1, 2, 3),
        k2 as (select sid, shard, row_number() over (partition by sid order by shard_size / (2 * i + 1) desc, shard, i) as place from
            (select sid, shard, shard_size, unnest(range(cast(2 * nb + 2 as bigint))) as i from h where shard_size > 0)),
        q2 as (select k2.sid, k2.shard, count(*) as quota from k2 join q1 on q1.sid = k2.sid where place <= q1.quota group by 1, 2),
        g as (select h.sid, h.shard, nb, least(coalesce(quota, 0), 2 * nb) as mine,
            case when nb > 0 then cast(('0x' || substr(md5(concat_ws('|', 'mix-1', 'run', coalesce(h.source, '-'), h.shard)), 1, 12)) as bigint) % cast(nb as bigint) else 0 end * 4 as start
            from h left join q2 on q2.sid = h.sid and q2.shard = h.shard),
        x as (select *, case when nb > 0 then floor(mine / nb) else 0 end as passes from g),
        y as (select *, start + (mine - passes * nb) * 4 as stop, nb * 4 as turn from x)
        select doc_id, size, cast(source_size as bigint) as source_size, target, cast(passes * size
            + greatest(least(at_ + size, stop, turn) - greatest(at_, start), 0) + greatest(least(at_ + size, stop - turn) - at_, 0) as bigint) as taken
        from o join y on y.sid = o.sid and y.shard = o.shard
    """,
}
